from .files import (
    normalise_exclude, read_adjustments, read_exclude, read_labels, read_registry, read_registry_source, read_responses,
    read_vendor_sales, unread_numbers, unread_sales,
)
from .registry import normalise_registry, read_registry_jdbc, unread_dates

__all__ = [
    "normalise_exclude", "normalise_registry", "read_adjustments", "read_exclude", "read_labels", "read_registry",
    "read_registry_jdbc", "read_registry_source", "read_responses", "read_vendor_sales", "unread_dates", "unread_numbers",
    "unread_sales",
]
