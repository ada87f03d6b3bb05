"""Sections of prompts: an exact partition of the serialised messages, and overlaps with token ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section tags.
INSTRUCTIONS, CODE, RAW_DATA, HISTORY, SYSTEM, DOCUMENT, UNLABELED = "instructions", "code", "raw data", "history dialog", "system message", "document text", "unlabeled"


# Tags of roles where prompts have headers and where they have none, and of headers; all others are instructions.
TEMPLATE_ROLES = {"system": SYSTEM, "assistant": HISTORY, "tool": RAW_DATA}
PLAIN_ROLES = {"system": SYSTEM, "user": DOCUMENT, "assistant": HISTORY, "tool": RAW_DATA}
HEADER_TAGS = {"Code": CODE, "Output": RAW_DATA, "Output of a previous step": RAW_DATA, "Task History": HISTORY}
# The header texts, by how they are set off.
BRACKETS = ["Instruction", "Code", "Output of a previous step", "Output", "Chosen action unit"]
BOLD = ["Function Tools", "Programming Setups", "General Guidelines", "Task History", "Task"]
PLAIN = ["Instruction", "Task History", "Available Action Units", "Current Context", "Context Variables", "Input Paths", "Output Paths", "Tools", "Programming Environment Setup", "NOTE", "FORMAT"]
HEADER = rf"(?m)^(?:\[(?:{'|'.join(BRACKETS)})\]:?|\*\*(?:{'|'.join(BOLD)}|TO DO:[^*\n]{{0,40}})\*\*:?|(?:{'|'.join(PLAIN)}):)"


def _tag(key: Column, tags: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in tags.items() for x in kv))[key], F.lit(INSTRUCTIONS))


def uses_headers(prompts: DataFrame, least: float = 2.0) -> bool:
    """Whether the user messages of a call hold ``least`` headers on average; one aggregate over the corpus."""
    mine = F.filter("messages", lambda m: m["role"] == "user")
    got = prompts.agg(F.avg(F.aggregate(mine, F.lit(0), lambda n, m: n + F.coalesce(F.regexp_count(m["content"], F.lit(HEADER)), F.lit(0))))).first()[0]
    return got is not None and got >= least


def prompt_sections(prompts: DataFrame, headers: bool | None = None) -> DataFrame:
    """(run_id, call, start, end, name, tag) of prompts with ``messages`` (array of role and content).

    The sections are an exact partition, in characters, of the serialised prompt, in which a message is
    ``<|role|>``, a line break, its content and a line break.  Without ``headers`` (null: as the corpus
    has them) each message is a section.  With them, user messages are cut where a header begins; what
    stands before the first one, the mark included, is the preamble.
    """
    headers = uses_headers(prompts) if headers is None else headers
    role, text = F.coalesce(F.when(F.col("m.role") != "", F.col("m.role")), F.lit("?")), F.coalesce("m.content", F.lit(""))
    # the end of each message: a running sum over its array
    sizes = F.transform("messages", lambda m: F.length(F.coalesce(F.when(m["role"] != "", m["role"]), F.lit("?"))) + F.length(F.coalesce(m["content"], F.lit(""))) + 6)
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    each = prompts.select("run_id", "call", F.explode(F.arrays_zip(F.col("messages").alias("m"), ends.alias("to"))).alias("x"))
    each = each.select("run_id", "call", F.col("x.m").alias("m"), F.col("x.to").alias("to"))
    each = each.select("run_id", "call", role.alias("role"), text.alias("text"), (F.col("to") - F.length(role) - F.length(text) - 6).alias("at"), "to")
    whole = lambda tag: F.array(F.struct(F.col("at").alias("start"), F.col("to").alias("end"), F.concat(F.lit("<"), "role", F.lit(">")).alias("name"), tag.alias("tag")))
    if not headers:
        parts = whole(_tag(F.col("role"), PLAIN_ROLES))
    else:
        # headers and the texts between them alternate, so their lengths give where each header begins
        each = each.withColumns({"heads": F.regexp_extract_all("text", F.lit(HEADER), F.lit(0)), "gaps": F.split("text", HEADER, -1)})
        each = each.withColumn("heads", F.when(F.col("role") == "user", F.col("heads")).otherwise(F.array()))
        size = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda s, x: s + F.length(x))
        begin = lambda i: F.col("at") + F.length("role") + 5 + size("gaps", i + 1) + size("heads", i)
        each = each.withColumn("cuts", F.concat(F.transform("heads", lambda h, i: begin(i)), F.array("to")))
        name = lambda h: F.regexp_extract(h, r"^[\[*]*([^\]*:\n]+)", 1)
        cut_up = F.transform("heads", lambda h, i: F.struct(F.element_at("cuts", i + 1).alias("start"), F.element_at("cuts", i + 2).alias("end"), name(h).alias("name"), _tag(name(h), HEADER_TAGS).alias("tag")))
        preamble = F.array(F.struct(F.col("at").alias("start"), F.col("cuts")[0].alias("end"), F.lit("preamble").alias("name"), F.lit(INSTRUCTIONS).alias("tag")))
        parts = F.when(F.col("role") != "user", whole(_tag(F.col("role"), TEMPLATE_ROLES))).when(F.size("heads") == 0, whole(F.lit(UNLABELED))).otherwise(F.concat(preamble, cut_up))
    return each.select("run_id", "call", F.explode(parts).alias("p")).select("run_id", "call", "p.*")


def token_spans(text: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Character ranges of tokens that occur one after the other in text."""
    out, at = [], 0
    for t in tokens:
        a = text.index(t, at)
        at = a + len(t)
        out.append((a, at))
    return out


def with_token_ranges(prompts: DataFrame, parts: DataFrame, tokenizer: Callable[[str], list[str]] = str.split) -> DataFrame:
    """parts with the token range [t0, t1) of each section: tokens that start inside it."""
    kinds = {c: prompts.schema[c].dataType.simpleString() for c in ("run_id", "call")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(3)]
            for r, c, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for col, v in zip(out, (r, c, [a for a, _ in token_spans(text or "", tokenizer(text or ""))]), strict=True):
                    col.append(v)
            yield pa.record_batch([pa.array(out[0], b.column(0).type), pa.array(out[1], b.column(1).type), pa.array(out[2], pa.list_(pa.int32()))], names=["run_id", "call", "at"])

    starts = prompts.select("run_id", "call", "prompt").mapInArrow(run, f"run_id {kinds['run_id']}, call {kinds['call']}, at array<int>")
    before = lambda c: F.size(F.filter("at", lambda x: x < F.col(c)))
    return parts.join(starts, ["run_id", "call"]).withColumns({"t0": before("start"), "t1": before("end")}).drop("at")


def overlap_by_tag(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """Tokens of each segment (run_id, call, seg, a, z) by tag of the sections of its call."""
    x = segments.join(parts.select("run_id", "call", "tag", "t0", "t1"), ["run_id", "call"]).filter("a < t1 and t0 < z")
    n = F.least("z", "t1") - F.greatest("a", "t0")
    return x.groupBy("run_id", "call", "seg", "tag").agg(F.sum(n).cast("long").alias("tokens"))


def widest_span(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """(run_id, call, seg, tag, lo, hi, name): the longest section of each tag inside each segment, cut
    to it; among equals the first by start."""
    x = segments.join(parts.select("run_id", "call", "tag", "name", "t0", "t1"), ["run_id", "call"]).filter("a < t1 and t0 < z")
    x = x.withColumns({"lo": F.greatest("a", "t0"), "hi": F.least("z", "t1")}).filter("lo < hi")
    best = F.min(F.struct((F.col("lo") - F.col("hi")).alias("n"), "lo", "hi", "name"))
    return x.groupBy("run_id", "call", "seg", "tag").agg(best.alias("w")).select("run_id", "call", "seg", "tag", "w.lo", "w.hi", "w.name")


def widest_tag(overlaps: DataFrame) -> DataFrame:
    """(run_id, call, seg, tag, tokens): the tag that holds most of each segment; among equals the first by name."""
    widest = F.min(F.struct((-F.col("tokens")).alias("n"), "tag"))
    return overlaps.groupBy("run_id", "call", "seg").agg(widest.alias("w")).select("run_id", "call", "seg", F.col("w.tag").alias("tag"), (-F.col("w.n")).alias("tokens"))


def content_breakdown(overlaps: DataFrame) -> DataFrame:
    """Share of tokens by tag; the shares of a run sum to 1."""
    by = overlaps.groupBy("run_id", "tag").agg(F.sum("tokens").alias("tokens"), F.count_distinct("call", "seg").alias("segments"))
    total = overlaps.groupBy("run_id").agg(F.sum("tokens").alias("all"))
    return by.join(total, "run_id").select("run_id", "tag", "tokens", "segments", F.round(F.col("tokens") / F.col("all"), 6).alias("share"))
