from larder.functions.exprs import (  # noqa: F401
    PERIOD_DAYS, SORT_OPTIONS, adult_cutoff, avg_half_up, date, dec, display_price, money, on_day, ordered,
    original_price, parse_id_list, period_filter, period_start, sort_key, truthy, ts, vat,
)
