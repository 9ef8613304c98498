from pricelens.sources.tables import read_table  # noqa: F401
from pricelens.sources.bars import (  # noqa: F401
    bars_from_ticks, lineitem_bars, read_bars, restrict_period, TIE_KEY,
)
