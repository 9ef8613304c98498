from pricelens.streaming.bars_stream import score_new_bars, tick_bars_stream, write_bars_stream  # noqa: F401
