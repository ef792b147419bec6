from .bundle import Bundle
from .estimators import estimate_inst, estimate_prepost
from .jobs import JobConfig, export_responses, raw_export, refresh_registry, run_annual, run_month
from .snapshots import RegistrySnapshots

__all__ = [
    "Bundle", "JobConfig", "RegistrySnapshots", "estimate_inst", "estimate_prepost", "export_responses", "raw_export",
    "refresh_registry", "run_annual", "run_month",
]
