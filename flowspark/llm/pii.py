"""Personal data in whole texts, found by anchors and local parsers.

One Aho-Corasick automaton finds the anchors of a text: at-signs, digits, plus signs, URL
schemes and cues of identifiers ("account", "IBAN", ...). A deterministic parser then expands
each anchor to its left and right and validates what it finds: email, ip, card and phone by
the base patterns (leftmost, non-overlapping per kind, failing matches dropped), url and
account besides. Every parser walks each character a bounded number of times.

Null texts are empty texts and have no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SPANS = "array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`|]+")
_ID = re.compile(r"[\x20:#=. -]{0,4}(?:(?i:no|nr|number|num)\b[\x20:#=.]{0,3})?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30}|[0-9](?:-?[0-9]){5,19})(?![A-Za-z0-9])")
_SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")
_CUES = ("account", "acct", "iban", "passport", "konto", "cuenta", "compte", "ssn")


@functools.lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "@+0123456789":
        found.add_word(c, (c if c in "@+" else "0", 1))
    for s in _SCHEMES:
        found.add_word(s, ("url", len(s)))
    for s in _CUES:
        for form in (s, s.upper(), s.capitalize()):
            found.add_word(form, ("id", len(form)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def _ips(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Four groups of digits with dots between, from left to right within a run of digits and dots."""
    groups = text[start:end].split(".")
    at = start
    k = 0
    while k + 3 < len(groups):
        four = groups[k : k + 4]
        if all(four):
            length = sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield ("ip", at, at + length)
            at += length + 1
            k += 4
        else:
            at += len(groups[k]) + 1
            k += 1


def _iban(code: str) -> bool:
    code = code.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, in the order of KINDS, then by start."""
    out: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    if not text:
        return []
    done = dict.fromkeys(("email", "dots", "card", "phone", "url", "account"), 0)
    for last, (what, length) in _anchors().iter(text):
        i = last - length + 1
        if what == "@":
            s = i
            while s > done["email"] and text[s - 1] in _LOCAL:
                s -= 1
            if s < i and (m := _DOMAIN.match(text, i + 1)):
                out["email"].append(("email", s, m.end()))
                done["email"] = m.end()
        elif what == "0":
            if i >= done["dots"]:
                done["dots"] = end = _DOTTED.match(text, i).end()
                if text.count(".", i, end) >= 3:
                    out["ip"] += _ips(text, i, end)
            if i >= done["card"]:
                m = _CARD.match(text, i)
                done["card"] = m.end() if m else i + 1
                if m and m.end() - i >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and _luhn(digits):
                        out["card"].append(("card", i, m.end()))
        elif what == "+":
            if i >= done["phone"] and (m := _PHONE.match(text, i)):
                done["phone"] = m.end()
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out["phone"].append(("phone", i, m.end()))
        elif what == "url":
            if i >= done["url"] and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    out["url"].append(("url", i, end))
                    done["url"] = end
        elif i >= done["account"] and not (i and text[i - 1].isalnum()) and (m := _ID.match(text, last + 1)):
            code = m[1]
            while code and not code[0].isdigit() and not _iban(code):
                code = code.rpartition(" ")[0]  # words after the number may look like its last group
            if code:
                out["account"].append(("account", m.start(1), m.start(1) + len(code)))
                done["account"] = m.start(1) + len(code)
    return [x for k in KINDS for x in out[k]]


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with [KIND] in place of each span; where spans overlap, the first and longest names the hole."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _scan(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found, clean = [], []
            for t in texts:
                text = t.as_py()
                spans = find_spans(text)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                if keep_text:
                    clean.append(redacted(text, spans))
            columns = [*batch.columns[:-1], pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(clean, pa.string())] if keep_text else columns, names=[*batch.schema.names[:-1], "spans", *["clean"] * keep_text])

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and spans, an array of (kind, start, end)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(False), f"id {dict(rows.dtypes)['id']}, spans {SPANS}").select(F.col("id").alias(id_col), "spans")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs with personal data in text_col replaced by [KIND]; null stays null."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])
    got = rows.mapInArrow(_scan(True), f"{fields}{', ' if fields else ''}spans {SPANS}, clean string")
    return got.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"c{others.index(c)}").alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(id_col, *[of(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
