"""Fixed schemas of the library's tables."""

from pyspark.sql import types as T

BARS = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("sector", T.StringType(), True),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("open", T.DoubleType(), True),
    T.StructField("high", T.DoubleType(), True),
    T.StructField("low", T.DoubleType(), True),
    T.StructField("close", T.DoubleType(), True),
    T.StructField("volume", T.DoubleType(), True),
])

NEWS_ITEM = T.StructType([
    T.StructField("content", T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("pubDate", T.StringType()),
        T.StructField("provider", T.StructType([T.StructField("displayName", T.StringType())])),
        T.StructField("canonicalUrl", T.StructType([T.StructField("url", T.StringType())])),
    ])),
])

# Model features, in the order the trained model expects them (fixed values).
FEATURES_7 = ["rsi", "macd", "macd_hist", "bb_position", "volume_ratio", "volatility",
              "daily_return"]
FUNDAMENTALS_3 = ["pe_ratio", "revenue_growth", "profit_margin"]
FEATURES_10 = FEATURES_7 + FUNDAMENTALS_3

LOG_ENTRY = T.StructType([
    T.StructField("retrained_at", T.StringType()),
    T.StructField("period", T.StringType()),
    T.StructField("horizon_days", T.IntegerType()),
    T.StructField("tickers_used", T.ArrayType(T.StringType())),
    T.StructField("tickers_skipped", T.ArrayType(T.StringType())),
    T.StructField("rows_per_ticker", T.MapType(T.StringType(), T.LongType())),
    T.StructField("total_rows", T.LongType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("baseline_always_up_acc", T.DoubleType()),
    T.StructField("lift_over_baseline_pp", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("down_precision", T.DoubleType()),
    T.StructField("down_recall", T.DoubleType()),
    T.StructField("down_f1", T.DoubleType()),
    T.StructField("confusion_matrix", T.StructType([
        T.StructField("tn", T.LongType()), T.StructField("fp", T.LongType()),
        T.StructField("fn", T.LongType()), T.StructField("tp", T.LongType())])),
    T.StructField("train_rows", T.LongType()),
    T.StructField("test_rows", T.LongType()),
    T.StructField("train_up_pct", T.DoubleType()),
    T.StructField("test_up_pct", T.DoubleType()),
    T.StructField("target_up_pct", T.DoubleType()),
    T.StructField("importance", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("sector_accuracy", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("split_method", T.StringType()),
    T.StructField("embargo_rows", T.IntegerType()),
    T.StructField("fundamentals_dropped", T.ArrayType(T.StringType())),
])
