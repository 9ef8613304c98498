"""pricelens: price-series analytics as Spark DataFrame operators.

Every public operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``). Bars are keyed by ``(ticker, ts)``; every series window is
partitioned by ``ticker`` and ordered by ``ts`` so that one hash exchange on the
ticker feeds all indicator windows of a plan.
"""

__all__ = ["session", "schema"]
