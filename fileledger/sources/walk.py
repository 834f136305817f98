"""Directory walking inside tasks. Small helpers; Spark hands out the directories."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator


def open_directory(directory: str) -> tuple[list[str], Iterator[str]]:
    """Sub-directories (links not followed) and a lazy iterator over the other entries."""
    folders: list[str] = []

    def others() -> Iterator[str]:
        with os.scandir(directory) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    folders.append(entry.path)
                elif not (entry.is_symlink() and os.path.isdir(entry.path)):
                    yield entry.path

    return folders, others()


def changed_after(directory: str, moment: float | None) -> bool:
    """Whether entries came or went, or the directory itself was moved, after the moment."""
    try:
        return moment is not None and os.lstat(directory).st_ctime > moment
    except OSError:
        return True


def walk(
    directory: str,
    deep: bool = True,
    renewed: bool = False,
    after: float | None = None,
    prefix: str = "",
) -> Iterator[tuple[str, str | None, bool]]:
    """Everything below a directory that is no directory: (path, error, renewed).

    Flat if not `deep`. Directories that hold no path beginning with `prefix` are not opened. `renewed` tells that a directory on the way changed after `after`: a file
    in a directory that was moved does not look changed itself.
    """
    waiting = [(directory, renewed)]
    while waiting:
        current, new = waiting.pop()
        folders, others = open_directory(current)
        try:
            for path in others:
                yield path, None, new
        except OSError as problem:
            yield current, str(problem), new
        if deep:
            waiting.extend(
                (folder, new or changed_after(folder, after)) for folder in folders if on_the_way(folder, prefix)
            )


def on_the_way(directory: str, prefix: str) -> bool:
    """Whether paths below the directory may begin with the prefix."""
    below = directory.rstrip("/") + "/"
    return below.startswith(prefix) or prefix.startswith(below)


def stat_row(path: str, error: str | None = None) -> tuple:
    """One listing row. A file that cannot be looked at becomes a row with `error` set."""
    is_link = is_file = False
    try:
        if error is None:
            is_link = os.path.islink(path)
            is_file = os.path.isfile(path)
            seen = os.stat(path) if is_file else os.lstat(path)
            return (
                path,
                seen.st_size,
                is_file,
                is_link,
                getattr(seen, "st_file_attributes", None),
                seen.st_ctime,
                seen.st_mtime,
                seen.st_atime,
                None,
                None,
            )
    except OSError as problem:
        error = str(problem)
    return (path, None, is_file, is_link, None, None, None, None, None, error)


def plan_subtrees(
    root: str, wanted: int, effort: int, after: float | None = None
) -> list[tuple[str, bool, bool]]:
    """Split a tree into (directory, whole subtree?, renewed?) pieces.

    Opens directories breadth first until there are enough pieces or `effort` entries were seen;
    file names are passed over, not kept. The root is where it always was, so it is not renewed.
    """
    pieces: list[tuple[str, bool, bool]] = []
    waiting, seen = deque([(root, False)]), 0
    while waiting and len(waiting) < wanted and seen < effort:
        current, new = waiting.popleft()
        folders, others = open_directory(current)
        try:
            for _ in others:
                seen += 1
                if seen >= effort:
                    break
            else:
                seen += len(folders)
                pieces.append((current, False, new))
                waiting.extend((folder, new or changed_after(folder, after)) for folder in folders)
                continue
        except OSError:
            pass
        # Too large to open here, or not readable: one task takes it as a whole.
        pieces.append((current, True, new))
    return pieces + [(directory, True, new) for directory, new in waiting]
