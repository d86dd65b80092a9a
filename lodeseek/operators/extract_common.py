"""Capsule rows made by Python workers."""

import hashlib
from collections.abc import Callable, Iterable

import pandas as pd

from lodeseek.schema import FIELDS


def capsule(path: str, kind: str, name: str, start: int, end: int, language: str, signature: str, ident: str | None = None, **more) -> dict:
    key = hashlib.sha256(f"{path}::{start}::{ident or signature}".encode()).hexdigest()[:32]
    props = [{"k": k, "v": str(v)} for k, v in more.pop("properties", [])]
    base = {"id": key, "type": kind, "name": name, "file_path": path, "start_line": start, "end_line": end, "language": language, "signature": signature}
    return base | {"content": "", "docstring": None, "calls": [], "imports": [], "properties": props, "seq": 0, "error": None} | more


def rows_to_frame(paths: Iterable[str], texts: Iterable[str], extract: Callable[[str, str, int], list[dict]]) -> pd.DataFrame:
    """Capsules of files, numbered within each; a failure in one file is a row of its own and stops no other."""
    out = []
    for k, (p, t) in enumerate(zip(paths, texts, strict=True)):
        try:
            got = extract(p, t, k)
        except Exception as e:  # one bad file must not end the job; the row says what happened
            got = [capsule(p, "error", "", 0, 0, "", "", error=f"{type(e).__name__}: {e}")]
        for i, c in enumerate(got):
            c["seq"] = i
        out += got
    return pd.DataFrame(out, columns=FIELDS).astype({"start_line": "int32", "end_line": "int32", "seq": "int32"})
