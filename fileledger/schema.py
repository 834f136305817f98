"""Column layouts of the tables the library reads and writes."""

from __future__ import annotations

#: One row per file; the central table.
INVENTORY = (
    "file_id bigint not null, path string not null, name string not null, ext string, "
    "size bigint not null, created timestamp_ntz, modified timestamp_ntz, accessed timestamp_ntz, "
    "attrs string, owner string, sha256 string, mime string, metadata string, "
    "ingested_at timestamp_ntz"
)

#: One row per (file, kind of work).
LEDGER = (
    "work_id bigint not null, file_id bigint not null, kind string, status string, priority int, "
    "attempts int, max_attempts int, error string, worker_id string, created_at timestamp_ntz, "
    "started_at timestamp_ntz, finished_at timestamp_ntz"
)

#: A fresh look at a directory tree, before anything is derived from it.
LISTING = (
    "path string, size bigint, is_file boolean, is_symlink boolean, attr_bits int, "
    "ctime double, mtime double, atime double, owner string, error string"
)

#: One row per file put into quarantine.
MANIFEST = (
    "original_path string, quarantine_path string, quarantine_date timestamp_ntz, file_id bigint"
)

# Kinds of work and states of a work item.
KINDS = ("hash", "analyze", "cleanup")
STATUSES = ("pending", "queued", "running", "done", "error", "retry")

# Kinds every new file gets, in the order that numbers its work items.
NEW_FILE_KINDS = ("hash", "analyze")
DEFAULT_MAX_ATTEMPTS = 3
