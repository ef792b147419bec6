from .dates import licence_year_end, licence_year_start, licence_year_text, month_end, parse_date
from .text import ascii_fold, blank_to_null, strip, yes_no

__all__ = [
    "ascii_fold", "blank_to_null", "licence_year_end", "licence_year_start",
    "licence_year_text", "month_end", "parse_date", "strip", "yes_no",
]
