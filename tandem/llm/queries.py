"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.text import terms
from tandem.llm import mixing, mojibake, packing, survivor
from tandem.llm.neighbours import NeighbourParams, nearest, recall
from tandem.llm.setjoin import SketchParams, expand, set_classes, similar_classes
from tandem.llm.termcounts import caption_counts, marked_terms
from tandem.llm.tokens import with_tokens
from tandem.llm.topn import top_n
from tandem.runtime import spread, stage, table

#: The kinds of sets with their names, least sizes and limits.
KINDS = {0: "caption", 1: "role"}
LEAST = {0: 12, 1: 8}
LIMITS = {0: SketchParams(limit=0.8), 1: SketchParams(limit=0.7)}
LISTS = ("subjects", "claims", "enacts", "subverts", "directed_at")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of both caption tables with its occurrences, records and mark."""
    both = caption_counts(spark, table(spark, sf_dir, "images"), table(spark, sf_dir, "corpusimage"))
    parts = [marked_terms(c, t).withColumn("tablename", F.lit(name)) for name, (c, t) in sorted(both.items())]
    return parts[0].unionByName(parts[1]).select("tablename", "term", "occurrences", "records", "mark")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_counts(spark, sf_dir).filter("mark IS NOT NULL").select("tablename", "term", "mark")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = F.lower(F.trim("selectedfor"))
    pairs = table(spark, sf_dir, "pairs").select("imageaid", pool.alias("selectedfor"), "compositescore", "imagebid", "id").filter("selectedfor <> ''")
    best = top_n(pairs, ["imageaid", "selectedfor"], "compositescore", ["imagebid", "id"], 3, copies=["imageaid", "selectedfor", "compositescore", "imagebid", "id"])
    return best.select("imageaid", "selectedfor", F.col("id").alias("pairid"))


def caption_sets(images: DataFrame) -> DataFrame:
    return images.select("id", F.array_distinct(terms(F.col("caption"))).alias("items"), F.col("caption").alias("text"))


def _role_items(text: str) -> list[str] | None:
    """The (field, value) items of a profile that is whole JSON; None for any other text."""
    try:
        whole = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    if not isinstance(whole, dict):
        return None
    out = {}
    for name in (*LISTS, "objects"):
        held = whole.get(name)
        for x in held if isinstance(held, list) else ():
            value = x.get("object") if name == "objects" and isinstance(x, dict) else x if name != "objects" else None
            value = value.strip(" ").lower() if isinstance(value, str) else ""
            if value:
                out[f"{name}\t{value}".encode("utf-8", "replace").decode("utf-8")] = None
    return list(out)


def _no_constant(name: str):
    raise ValueError(name)


def role_sets(images: DataFrame) -> DataFrame:
    """(id, items, text) of the profiles whose stored text starts with { and is whole JSON.

    One pass of a JSON parser over each text: to test every element for being a string, the built-in variant
    functions read each text many times over, at about twenty times the cost."""
    rows = images.filter(F.col("roleprofile").startswith("{")).select("id", F.col("roleprofile").alias("text"))

    def run(batches):
        for b in batches:
            items = pa.array([_role_items(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), items, b.column(1)], names=["id", "items", "text"]).filter(items.is_valid())

    return spread(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, items array<string>, text string")


def _similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the classes of equal caption sets and role sets."""
    images = table(spark, sf_dir, "images")
    sets = caption_sets(images).withColumn("kind", F.lit(0)).unionByName(role_sets(images).withColumn("kind", F.lit(1)))
    classes, members = set_classes(sets, "id", "items", LEAST, "kind", "text")
    return stage(similar_classes(classes, LIMITS), "similar"), members


def _kind_name():
    return F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("kind")].alias("kind")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(*_similar(spark, sf_dir)).select("id_lo", "id_hi", _kind_name())


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, classid, links): each image's class of equal sets and how many other classes it is linked to."""
    pairs, members = _similar(spark, sf_dir)
    ends = pairs.select("kind", F.explode(F.array("a", "b")).alias("cid")).groupBy("kind", "cid").agg(F.count("*").alias("links"))
    once = members.select("kind", "id", "cid").distinct()
    return once.join(ends, ["kind", "cid"], "left").select(_kind_name(), "id", F.col("cid").alias("classid"), F.coalesce("links", F.lit(0)).alias("links"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(table(spark, sf_dir, "clipoutput"), "imageid", "embedding")
    return near.select(F.least("id", "neighbour").alias("id_lo"), F.greatest("id", "neighbour").alias("id_hi")).distinct()


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall(table(spark, sf_dir, "clipoutput"), "imageid", "embedding", p=NeighbourParams())


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.survivors(table(spark, sf_dir, "images"))


def p6_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption of each duplicate group that is closest to the token consensus of its captions."""
    got = survivor.consensus(table(spark, sf_dir, "images"), "duplicategroupid", "id", "caption")
    return got.select("duplicategroupid", F.col("id").alias("imageid"), F.col("value").alias("caption"), "members", "closeness")


def budgets(spark: SparkSession, sf_dir: str) -> dict[int, int]:
    return {r.budgetid: r.capacitytokens for r in table(spark, sf_dir, "tokenbudgets").filter("budgetid IS NOT NULL AND capacitytokens > 0").collect()}


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, int]]:
    caps = budgets(spark, sf_dir)
    sized = with_tokens(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return packing.pack(sized, caps), caps


def p7_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's prompt for each token budget."""
    return _packed(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(*_packed(spark, sf_dir))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the prompts of each budget: documents placed whole, containers over the capacity, holes in the
    numbering, documents cut although they fit, and whether there are at most 1 % (or one) more than the sizes need."""
    packed, caps = _packed(spark, sf_dir)
    packed = stage(packed, "packed")
    cap = F.create_map(*(F.lit(int(x)) for kv in caps.items() for x in kv))[F.col("budgetid")]
    load = packed.groupBy("budgetid", "containerid").agg(F.sum("size").alias("load"))
    boxes = load.groupBy("budgetid").agg(F.count_if(F.col("load") > cap).alias("overfull"), (F.max("containerid") + 1 - F.count("*")).alias("holes"), F.count("*").alias("n"), F.sum("load").alias("size"))
    docs = packed.groupBy("budgetid", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"))
    whole = docs.groupBy("budgetid").agg(F.count("*").alias("documents"), F.count_if(F.col("pieces") != F.ceil(F.col("size") / cap)).alias("cut"))
    tight = F.col("n") <= F.greatest(F.ceil(F.col("size") / cap) * 1.01, F.ceil(F.col("size") / cap) + 1)
    return boxes.join(whole, "budgetid").select("budgetid", "documents", "overfull", "holes", "cut", tight.alias("tight"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "sourcetargets").filter("source IS NOT NULL").collect()
    targets = {r.source: (r.targetshare or 0.0, r.maxrepeats or 0) for r in rows}
    docs = table(spark, sf_dir, "documents").filter(F.col("source").isin(*targets))
    return mixing.mix(with_tokens(docs, "text", ["doc_id", "source"]), targets)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of each target source in the mixture: its target, the most repeats of a document over the allowed
    ones, documents from another source, and whether its size is what it was due, to within 0.005 of the mixture or
    to where no unused document fits any more."""
    mixture, report = _mixed(spark, sf_dir)
    whole = report.agg(F.sum("due")).first()[0] or 0
    times = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("times"), F.count_distinct("repeat").alias("turns"))
    home = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("home"))
    per = times.join(home, "doc_id").groupBy("source").agg(F.max("times").alias("most"), F.count_if(F.col("times") != F.col("turns")).alias("twice"), F.count_if(F.col("source") != F.col("home")).alias("strangers"))
    none = lambda c: F.coalesce(c, F.lit(0))
    docs = with_tokens(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"]).filter("tokens > 0").join(times.select("doc_id", "times"), "doc_id", "left")
    turns = report.select("source", F.greatest("repeats", F.lit(1)).alias("turns"))
    sized = docs.join(turns, "source").filter(none("times") < F.col("turns")).groupBy("source").agg(F.min(F.col("tokens")).alias("least"))
    return report.join(per, "source", "left").join(sized, "source", "left").select(
        "source", "targetshare", F.greatest(none("most") - F.col("maxrepeats"), F.lit(0)).alias("over"), none("twice").alias("twice"), none("strangers").alias("strangers"),
        (F.abs(F.col("tokens") - F.col("due")) <= F.greatest(F.lit(0.005 * whole), F.coalesce(F.col("least") - 1, "due"))).alias("near"), ((F.col("due") > 0) | (F.col("items") == 0)).alias("present"),
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned, _, _ = mojibake.learn(docs)
    return mojibake.judged(docs, learned).filter("garbled").select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned, _, both = mojibake.learn(docs)
    return mojibake.restore_lost(mojibake.judged(docs, learned).filter("garbled").select("doc_id", "restored"), both)


def p9_misreadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The misreadings the twins speak for, with the number of windows that do."""
    return mojibake.learn(table(spark, sf_dir, "documents"))[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_counts, p2_found, p3_found, p3_classes, p5_found, p5_recall, p6_found, p6_consensus, p7_prompts, p7_fill, p7_invariants, p8_mixture, p8_shares, p8_invariants, p9_found, p9_restored, p9_misreadings)
}
