"""File-inventory analytics on Spark: scan, hash, find copies, report, and plan clean-ups."""

from pyspark import cloudpickle

from fileledger.operators.duplicates import (
    duplicate_groups,
    duplicate_members,
    files_sharing_a_size,
    find_duplicates,
    removable_files,
)
from fileledger.functions import text
from fileledger.operators.enrich import (
    describe_content,
    extract_metadata,
    files_left,
    hash_content,
    hash_files,
    merge_results,
    metadata_gate,
    outcomes_of,
)
from fileledger.operators import search
from fileledger.operators.reports import (
    analyze,
    find_empty,
    find_large,
    find_old,
    find_temp,
    search_metadata,
)
from fileledger.operators.scan import (
    append_inventory,
    refresh_inventory,
    rejected_files,
    resume_new_files,
    scan,
    scan_inventory,
    scan_totals,
)
from fileledger.operators.search import search_with_postings, write_postings
from fileledger.plans.clean import clean_plan, clean_preview, clean_totals
from fileledger.plans.quarantine import list_quarantine, quarantine_plan, restore_plan
from fileledger.sources import content, directory, json_arrays, objects, sidecars, walk
from fileledger.sources.objects import hash_objects, list_objects
from fileledger.sources.reports import read_report, report_items, write_report

# The functions run inside tasks travel with the job, so executors need no copy of the package.
for _module in (content, directory, json_arrays, objects, search, sidecars, text, walk):
    cloudpickle.register_pickle_by_value(_module)

__all__ = [
    "analyze",
    "append_inventory",
    "clean_plan",
    "clean_preview",
    "clean_totals",
    "describe_content",
    "duplicate_groups",
    "duplicate_members",
    "extract_metadata",
    "files_left",
    "files_sharing_a_size",
    "find_duplicates",
    "find_empty",
    "find_large",
    "find_old",
    "find_temp",
    "hash_content",
    "hash_files",
    "hash_objects",
    "list_objects",
    "list_quarantine",
    "merge_results",
    "metadata_gate",
    "outcomes_of",
    "quarantine_plan",
    "read_report",
    "refresh_inventory",
    "rejected_files",
    "removable_files",
    "report_items",
    "restore_plan",
    "resume_new_files",
    "scan",
    "scan_inventory",
    "scan_totals",
    "search_metadata",
    "search_with_postings",
    "write_postings",
    "write_report",
]
