"""Files that a path names, on any store that pyarrow knows."""

from __future__ import annotations

import re


def store_of(path: str) -> tuple:
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def pattern(text: str) -> re.Pattern:
    """A path pattern of *, ? and [...], none of which matches a slash."""
    out = []
    for part in re.split(r"(\*|\?|\[[^\]/]+\])", text):
        if part in ("*", "?"):
            out.append("[^/]*" if part == "*" else "[^/]")
        elif part.startswith("[") and part.endswith("]"):
            out.append("[" + ("^/" + part[2:-1] if part[1] in "!^" else part[1:-1]) + "]")
        else:
            out.append(re.escape(part))
    return re.compile("".join(out))


def files(path: str, endings: tuple[str, ...], kind: str) -> list[str]:
    """Paths, as the path's file system knows them, of all files that it names, in order; of a folder those with one of some endings. None is an error."""
    from pyarrow import fs

    store, at = store_of(path)
    found_kind = store.get_file_info(at).type
    if found_kind == fs.FileType.File:
        return [at]
    if found_kind == fs.FileType.Directory:
        within = store.get_file_info(fs.FileSelector(at))
        found = [x.path for x in within if x.type == fs.FileType.File and x.path.endswith(endings)]
    else:
        base = re.split(r"[*?\[]", at)[0].rpartition("/")[0] or ("/" if at.startswith("/") else ".")
        wanted = pattern(at if base != "." else "./" + at.removeprefix("./"))
        within = store.get_file_info(fs.FileSelector(base, recursive="/" in at[len(base) + 1 :], allow_not_found=True))
        found = [x.path for x in within if x.type == fs.FileType.File and wanted.fullmatch(x.path)]
    if not found:
        raise FileNotFoundError(f"no {kind} file at {path}")
    return sorted(found)
