"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the hash of its content. The ledger records
which rule versions have seen which blob and what they found. A scan reads the text of
one copy of each blob, only where a rule version is missing, appends to the ledger, and
joins all findings back to every path that holds the blob. Everything runs as DataFrame
expressions: a rule's matches are wrapped in marks, the text is cut at the marks, and
the lengths of the pieces give the places.

A scan first finds the unseen blobs among hashes alone. Their bits in a bitmap of fixed size
then keep the texts of other blobs from being moved, but for a few that share a bit, and
an exact join drops those.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .common import store

_CUT, _SECRET, _OTHER = "\x01", "\x02", "\x03"
_SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"
_PIECES = 256  # of a text whose places are added up together
_BITS = 1 << 26  # of the bitmap of unseen blobs: 8 MB
_BUCKET = 1 << 15  # bits of one row of it


@dataclasses.dataclass(frozen=True)
class Rule:
    """``pattern`` has the secret in ``group`` (0: all of the match); matches whose
    secret is shorter than ``least`` are dropped after matching. A changed rule gets
    another version and is run again over all blobs."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, then those of this scanner.
BASE = (
    Rule("assign", r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # shorter runs would be dropped anyway
)
RULES = BASE + (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1),
)


def spans(text: Column, rule: Rule, place: int) -> Column:
    """Places of the rule's matches, leftmost and not overlapping, in code points.

    Adding up lengths copies what was found at every step, so it is done within blocks of
    ``_PIECES`` pieces, and for the blocks: a text of very many matches takes time in
    proportion, nearly."""
    wrap = f"{_CUT}$1{_SECRET}$2{_CUT}" if rule.group else f"{_CUT}{_SECRET}$0{_CUT}"
    pieces = F.split(F.regexp_replace(text, rule.pattern, wrap), _CUT)

    def measured(piece: Column) -> Column:
        is_match = F.contains(piece, F.lit(_SECRET))
        secret = F.char_length(F.substring_index(piece, _SECRET, -1))
        return F.struct(
            (F.char_length(piece) - F.when(is_match, 1).otherwise(0)).alias("n"),
            (is_match & (secret >= rule.least)).alias("hit"),
        )

    def inside(block: Column, begin: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            end = state["at"] + piece["n"]
            span = F.struct(
                state["at"].alias("start"), F.lit(place).alias("place"), end.alias("end"),
                F.lit(rule.kind).alias("kind"),
            )
            found = F.when(piece["hit"], F.concat(state["found"], F.array(span))).otherwise(state["found"])
            return F.struct(end.alias("at"), found.alias("found"))

        start = F.struct(begin.alias("at"), F.array().cast(_SPANS).alias("found"))
        return F.aggregate(block, start, step, lambda s: s["found"])

    def in_blocks(blocks: Column) -> Column:
        def next_begin(begins: Column, block: Column) -> Column:
            size = F.aggregate(block, F.lit(0), lambda s, piece: s + piece["n"])
            return F.concat(begins, F.array(F.element_at(begins, -1) + size))

        begins = F.aggregate(blocks, F.array(F.lit(0)), next_begin)
        return _once(begins, lambda b: F.flatten(F.transform(blocks, lambda x, i: inside(x, b[i]))))

    def several(all_pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_pieces) - 1) / _PIECES).cast("int"))
        blocks = F.transform(numbers, lambda i: F.slice(all_pieces, i * _PIECES + 1, _PIECES))
        return _once(blocks, in_blocks)

    none = F.array().cast(_SPANS)
    return F.when(F.size(pieces) > 1, _once(F.transform(pieces, measured), several)).otherwise(none)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, not again for every element of the
    functions that ``use`` applies."""
    return F.transform(F.array(value), use)[0]


def _plain(text: Column) -> Column:
    """Without the characters that serve as marks; no rule matches any of them."""
    return F.replace(F.replace(text, F.lit(_CUT), F.lit(_OTHER)), F.lit(_SECRET), F.lit(_OTHER))


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, text, blob): the content hash of every version; null is the empty text."""
    return docs.select(
        F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("blob", F.sha2("text", 256))


class Ledger:
    """Scan results by blob in a folder that all machines share."""

    kinds = "blob string, rules array<string>, found " + _SPANS

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or scratch_path(spark, "secret-ledger")
        # An empty first entry, so that there is something to read.
        spark.createDataFrame([], self.kinds).write.mode("append").parquet(self.folder)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.kinds).parquet(self.folder)

    def unseen_blobs(self, blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, seen): of the given hashes those that some rule version has not seen."""
        seen = self.entries().groupBy("blob").agg(
            F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen")
        )
        wanted = F.array(*[F.lit(r.key) for r in rules])
        return blobs.select("blob").distinct().join(seen, "blob", "left").withColumn(
            "seen", F.coalesce("seen", F.array().cast("array<string>"))
        ).where(F.size(F.array_except(wanted, "seen")) > 0)

    def likely(self, found: DataFrame, new: DataFrame) -> DataFrame:
        """Rows of ``found`` whose blob is in ``new``, and a few others: those whose bit is
        set in a bitmap of fixed size, one row for each bucket of bits."""
        bit = F.pmod(F.xxhash64("blob"), F.lit(_BITS))
        split_up = [(bit / _BUCKET).cast("int").alias("bucket of bits"), (bit % _BUCKET).alias("place of the bit")]
        bits = (
            new.select(*split_up).groupBy("bucket of bits")
            .agg(F.bitmap_construct_agg("place of the bit").alias("bits"))
        )
        byte = F.substring("bits", (F.col("place of the bit") / 8).cast("int") + 1, F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        is_set = F.getbit(value, (F.col("place of the bit") % 8).cast("int")) == 1
        # The bitmap has at most _BITS / 8 bytes.
        return found.select("*", *split_up).join(F.broadcast(bits), "bucket of bits").where(is_set).select(found.columns)

    def unseen(self, found: DataFrame, rules: tuple[Rule, ...], blobs: DataFrame | None = None) -> DataFrame:
        """(blob, text, seen): one copy of each blob that some rule version has not seen.
        ``blobs`` may hold the hashes of ``found`` ready."""
        new = store(self.unseen_blobs(found if blobs is None else blobs, rules), "unseen-blobs")
        copies = self.likely(found, new).groupBy("blob").agg(F.first("text").alias("text"))
        return copies.join(new, "blob")

    def scan(
        self, found: DataFrame, rules: tuple[Rule, ...] = RULES, blobs: DataFrame | None = None
    ) -> None:
        """Scan what is new in ``found`` (path, text, blob) and record it. Entries are
        appended by one write, which commits whole or not at all. An entry names the
        versions behind its spans, so ``rules`` may hold one version of each kind."""
        if len({r.kind for r in rules}) < len(rules):
            raise ValueError("two versions of one kind in a scan")
        text = _plain(F.col("text"))
        missing = [~F.array_contains("seen", r.key) for r in rules]
        new = self.unseen(found, rules, blobs).select(
            "blob",
            F.array_compact(F.array(*[F.when(m, F.lit(r.key)) for m, r in zip(missing, rules)])).alias("rules"),
            F.concat(*[
                F.when(m, spans(text, r, k)).otherwise(F.array().cast(_SPANS))
                for k, (m, r) in enumerate(zip(missing, rules))
            ]).alias("found"),
        )
        new.write.mode("append").parquet(self.folder)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, found): spans of the given rule versions by start, then rule, for blobs
        that have any."""
        current = F.array_compact(F.array(*[
            F.when(F.array_contains("rules", r.key), F.lit(r.kind)) for r in rules
        ]))
        rows = self.entries().where("size(found) > 0").select(
            "blob", F.filter("found", lambda s: F.array_contains(current, s["kind"])).alias("found")
        )
        return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """(path, blob, found): one row per row of ``docs``, the spans of all its secrets
    (kind, start, end; end exclusive), ordered by start, then rule. Null texts count as
    empty. With a ledger of earlier scans only new blobs and rules are scanned."""
    ledger = ledger or Ledger(docs.sparkSession)
    found = versions(docs)
    names = store(found.select("path", "blob"), "secret-paths")
    ledger.scan(found, rules, names)
    return names.join(ledger.findings(rules), "blob", "left").select(
        "path", "blob", F.coalesce("found", F.array().cast(_SPANS)).alias("found")
    )


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda s: s["kind"] == kind)


def scan_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, a count for each base kind, base_sha256 (of
    the base spans' list) and spans (the list of all spans)."""
    base = [r.kind for r in BASE]
    rows = secrets(docs, rules).withColumn("b", F.filter("found", lambda s: s["kind"].isin(base)))
    return rows.select(
        F.col("path").cast("long").alias("doc_id"),
        *[
            F.size(_of_kind(F.col("found"), k)).cast("long").alias(f"n_{k}") for k in base
        ],
        F.sha2(listed(F.col("b")), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; overlapping spans are
    replaced as one. Texts without secrets, null ones included, stay as they are."""
    found = Ledger(docs.sparkSession)
    found.scan(versions(docs), rules)
    name = "blob of the ledger"
    rows = docs.withColumn(name, F.sha2(F.coalesce("text", F.lit("")), 256))
    spans_ = found.findings(rules).select(F.col("blob").alias(name), F.col("found").alias("spans of the ledger"))

    def step(state: Column, s: Column) -> Column:
        begin = F.greatest(state["at"], s["start"])
        kept = F.substr(F.col("text"), state["at"] + 1, F.greatest(begin - state["at"], F.lit(0)))
        fresh = s["end"] > state["at"]
        joins = (s["start"] < state["at"]) & (state["at"] > 0)
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh & ~joins, F.concat(state["out"], kept, F.lit(mask))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate(
        "spans of the ledger", start, step,
        lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1, F.char_length("text"))),
    )
    return rows.join(spans_, name, "left").withColumn(
        "text", F.when(F.size("spans of the ledger") > 0, text).otherwise(F.col("text"))
    ).select(*[F.col(f"`{c}`") for c in docs.columns])
