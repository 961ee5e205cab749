"""Secret scanning over an incremental ledger of content-addressed blobs.

``history`` holds every version of every path. A version's text is addressed by
its SHA-256, so a text that many paths or versions share is one blob. The ledger
lists the (blob, rule_version) pairs that were scanned, with their findings; a
run scans only pairs that it lacks and joins all findings back to all paths.

Without a ledger all blobs are unseen: texts are scanned where they are, a text that
a task meets again only once, and ledger rows of one blob are merged after. With a
ledger, keys alone are moved to find the unseen blobs, and texts are joined with them
by their keys, which moves each text once, copies too; those of one text meet in one
task, which scans the first and passes over the rest.

Null texts count as empty, empty texts are blobs without findings, repeated rows
give repeated result rows, an empty table an empty result. Columns that the
input has besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import checkpointed, lean, small_batches, whole

#: Grows whenever a rule changes: blobs are then scanned anew.
RULE_VERSION = 1
#: The base rules, in the order in which kinds sort at one start.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Rules of this operator besides the base ones.
EXTRA = (
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("bearer", re.compile(r"\b(?:ghp|gho|ghs|xoxb|xoxp|sk_live)_?[-_]?[A-Za-z0-9]{20,}")),
)
ORDER = {kind: i for i, kind in enumerate((*BASE_KINDS, *(k for k, _ in EXTRA)))}


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, by start, then kind as listed.

    A run of hex digits of 32 or more is the same span whether the length is in
    the pattern or tested after; so is an access key. An assignment's value is
    tested after the match, since a shorter pattern could restart inside it.
    """
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, rule in EXTRA:
        spans += [(m.start(), m.end(), kind) for m in rule.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


FOUND = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    met: set[str] = set()
    for frame in frames:
        rows = []
        for blob, text in zip(frame["blob"], frame["text"], strict=True):
            if blob in met:
                continue
            if len(met) < 100_000:
                met.add(blob)
            spans = find(text)
            base = [s for s in spans if s[2] in BASE_KINDS]
            kinds = [s[2] for s in base]
            rows.append((blob, *(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        yield pd.DataFrame(rows, columns=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def addressed(history: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, blob, text): null texts as empty."""
    text = whole(text_col)
    return history.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan_blobs(history: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """New ledger rows: the findings of every blob that ``ledger`` lacks under ``rule_version``."""
    small_batches(history.sparkSession)
    blobs = addressed(history, id_col, text_col).select("blob", "text")
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        unseen = blobs.select("blob").distinct().join(seen, "blob", "left_anti")
        blobs = blobs.join(unseen, "blob", "left_semi")
    return blobs.mapInPandas(lean(_scan), FOUND).dropDuplicates(["blob"]).withColumn("rule_version", F.lit(rule_version))


def advanced(history: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """The ledger after a run over ``history``: its rows of before, and those of unseen (blob, rule_version) pairs."""
    new = scan_blobs(history, ledger, id_col, text_col, rule_version)
    return checkpointed(new if ledger is None else ledger.unionByName(new))


def findings(history: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """The ledger's findings joined back to every path and version; null where the ledger lacks its blob."""
    paths = addressed(history, id_col, text_col).select(F.col("id").alias(id_col), "blob")
    return paths.join(ledger.filter(F.col("rule_version") == rule_version), "blob", "left")


def masked(text: str, spans: str) -> str:
    """``text`` with every span of ``spans`` (as in the ledger) replaced by [SECRET]; overlapping spans as one."""
    out, at = [], 0
    for part in spans.split(",") if spans else []:
        _, start, end = part.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], "[SECRET]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])
