from milepost.functions.timefmt import as_of_lit, cet_text, parse_as_of, to_instant, utc_day  # noqa: F401
