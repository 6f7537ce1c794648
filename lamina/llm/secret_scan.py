"""Secrets in texts, with multipart credentials linked inside a scope.

Strong forms stand alone: an assignment to a telling name, an access key id, a long run of hex
digits. Weak forms are common in clean text and mean something only together: a login name, a long
mixed token, a network address. The parts of a text are intervals. Each weak part is joined to the
nearest parts of the complementary roles in its scope, a paragraph and ``reach`` code points to either
side, and is reported only if they are there:

* a weak identifier needs a secret,
* a weak secret needs an identifier or an endpoint,
* an endpoint needs an identifier and a secret.

A text is one row and bounds every scope, so the interval join runs in that row's task over sorted
intervals and shuffles nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.batches import map_texts

#: The strong forms and their least lengths, in the order in which ties are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

IDENTITY = r"""\b(?:client_?id|user_?(?:name|id)?|login|account(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"\b(?:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|\b(?:host|endpoint|server|hostname)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,}"
KINDS = ("assign", "access", "hex", "identity", "opaque", "endpoint")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identity": "identifier", "opaque": "secret", "endpoint": "endpoint"}
NEEDS = {"identity": (("secret",),), "opaque": (("identifier", "endpoint"),), "endpoint": (("identifier",), ("secret",))}
PARTS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def _compiled() -> dict[str, re.Pattern]:
    # ASCII: under Unicode rules a long s and the Kelvin sign would match letters of the names.
    either = re.IGNORECASE | re.ASCII
    return {
        "assign": re.compile(ASSIGN, either), "access": re.compile(ACCESS), "hex": re.compile("[0-9a-f]{24,}"),
        "identity": re.compile(IDENTITY, either), "opaque": re.compile(OPAQUE), "endpoint": re.compile(ENDPOINT, either),
    }


def strong_parts(text: str, forms: dict[str, re.Pattern]) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the strong forms: per kind leftmost matches, then those long enough."""
    lowered = text.lower()
    found = []
    if any(word in lowered for word in ("passw", "secret", "token", "key")):
        found += [(*m.span(), "assign") for m in forms["assign"].finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in forms["access"].finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # A run of hex digits is matched whole from its first digit, so asking for 24 digits finds the same.
    found += [(*m.span(), "hex") for m in forms["hex"].finditer(text)]
    return found


def linked_parts(text: str, strong: list[tuple[int, int, str]], forms: dict[str, re.Pattern], reach: int) -> list[tuple[int, int, str]]:
    """The weak parts whose complementary parts lie in the same paragraph, at most ``reach`` away."""
    weak = []
    if "://" in text or "=" in text or ":" in text:
        weak += [(*m.span(), "identity") for m in forms["identity"].finditer(text)]
        weak += [(*m.span(), "endpoint") for m in forms["endpoint"].finditer(text)]
    taken = sorted((s, e) for s, e, _ in strong)
    starts = [s for s, _ in taken]
    reached = list(accumulate((e for _, e in taken), max))

    def overlaps(start: int, end: int) -> bool:
        at = bisect_left(starts, end)
        return at > 0 and reached[at - 1] > start

    weak += [(*m.span(), "opaque") for m in forms["opaque"].finditer(text)]
    weak = [part for part in weak if not overlaps(part[0], part[1])]
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    # Per paragraph and role the intervals in order of their start, and the largest end so far: the
    # nearest one on either side of a part is then a binary search away.
    table: dict[tuple[int, str], tuple[list[int], list[int]]] = {}
    for start, end, kind in sorted(strong + weak):
        begins, ends = table.setdefault((bisect_right(breaks, start), ROLE[kind]), ([], []))
        begins.append(start)
        ends.append(max(end, ends[-1]) if ends else end)

    def near(part: tuple[int, int, str], role: str) -> bool:
        begins, ends = table.get((bisect_right(breaks, part[0]), role), ([], []))
        at = bisect_left(begins, part[0])
        before = at > 0 and ends[at - 1] >= part[0] - reach
        return before or (at < len(begins) and begins[at] <= part[1] + reach)

    return [part for part in weak if all(any(near(part, role) for role in either) for either in NEEDS[part[2]])]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """``(id, parts)`` per row of ``docs``: all spans by start, then kind, in code points, end exclusive.

    ``base`` tells strong parts from linked ones. Null and empty texts have no parts. Repeated rows
    and null ids keep their rows. Texts are scanned whole. Further columns are not read.
    """

    def work():
        forms = _compiled()
        order = {kind: at for at, kind in enumerate(KINDS)}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                strong = strong_parts(text, forms) if text else []
                weak = linked_parts(text, strong, forms, reach) if text else []
                parts = [(s, order[k], e, k, True) for s, e, k in strong] + [(s, order[k], e, k, False) for s, e, k in weak]
                rows.append([{"kind": k, "start": s, "end": e, "base": b} for s, _, e, k, b in sorted(parts)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "parts"])

        return step

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(picked, 1, work, f"id {docs.schema[id_col].dataType.simpleString()}, parts {PARTS}")


def redact(docs: DataFrame, text_col: str = "text", reach: int = 200) -> DataFrame:
    """``docs`` with every secret and linked part of a text replaced by its kind in brackets.

    Overlapping parts become one, named by the first. Texts without parts, null ones among them, are
    left as they are; ``n_chars``, where there is such a column, is counted anew for changed ones.
    """
    columns = docs.columns
    counted = "n_chars" in columns

    def run(batches):
        from lamina.llm.batches import cut

        forms, at = _compiled(), columns.index(text_col)
        order = {kind: n for n, kind in enumerate(KINDS)}
        for whole in batches:
            for batch in cut(whole, at):
                texts = batch.column(at).to_pylist()
                lengths = batch.column(columns.index("n_chars")).to_pylist() if counted else None
                for n, text in enumerate(texts):
                    strong = strong_parts(text, forms) if text else []
                    parts = strong + linked_parts(text, strong, forms, reach) if text else []
                    if not parts:
                        continue
                    pieces, done = [], 0
                    for start, end, kind in sorted(parts, key=lambda p: (p[0], order[p[2]])):
                        if start >= done:
                            pieces += [text[done:start], f"[{kind}]"]
                        done = max(done, end)
                    texts[n] = "".join(pieces) + text[done:]
                    if counted:
                        lengths[n] = len(texts[n])
                arrays = list(batch.columns)
                arrays[at] = pa.array(texts, pa.string())
                if counted:
                    arrays[columns.index("n_chars")] = pa.array(lengths, batch.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(run, docs.schema)
