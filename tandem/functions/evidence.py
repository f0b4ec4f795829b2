"""Evidence over captions: does a quote occur, is it sign text, and what verdict verified findings give."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import vocab
from tandem.functions.text import normalize_evidence

KINDS = ("text_vs_world", "source_receiver", "same_subject_reversal", "real_vs_depicted", "gesture_echo")
TYPES = {"text_vs_world": "ironic", "source_receiver": "complementary", "same_subject_reversal": "contrastive", "real_vs_depicted": "contrastive", "gesture_echo": "echo"}
FINDINGS = "array<struct<kind:string,quoteA:string,quoteB:string,explicitA:boolean,explicitB:boolean,note:string>>"


def words(text: Column) -> Column:
    """Tokens of letters and digits of a normalised text."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bare(text: Column) -> Column:
    return F.regexp_replace(text, "[\"']", "")


def quote_matches(quote: Column, caption: Column) -> Column:
    """True where the caption holds the quote, quote marks aside, or one of its sentences holds the quote's three
    or more words in order.  Null or blank quotes and null captions: False."""
    q, c = normalize_evidence(F.coalesce(quote, F.lit(""))), normalize_evidence(F.coalesce(caption, F.lit("")))
    qw = words(q)
    step = lambda i, t: F.when(t == F.try_element_at(qw, i), i + 1).otherwise(i)
    in_order = lambda s: F.aggregate(words(s), F.lit(1), step) > F.size(qw)
    return (q != "") & (F.contains(bare(c), bare(q)) | ((F.size(qw) >= 3) & F.exists(F.split(c, "[.!?]"), in_order)))


def _normal(s: str) -> str:
    for a, b in (("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"')):
        s = s.replace(a, b)
    return " ".join(s.lower().split())


def _bare(s: str) -> str:
    return s.replace('"', "").replace("'", "").strip()


def _tokens(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", s)


def content_words(s: str) -> list[str]:
    return [t for t in _tokens(_normal(s)) if len(t) >= 3 and t not in vocab.MESSAGE_STOP_WORDS]


def quoted_regions(caption: str) -> list[str]:
    """What stands between quote marks: all double ones in turn, then single ones; an apostrophe in or after a word
    opens nothing."""
    c = _normal(caption)
    marks = [i for i, ch in enumerate(c) if ch == '"']
    out = [c[a + 1 : b] for a, b in zip(marks[::2], marks[1::2])]
    start = None
    for m in re.finditer("'", c):
        i = m.start()
        before, after = c[i - 1 : i] or " ", c[i + 1 : i + 2] or " "
        if before.isalpha() and after.isalpha():
            continue
        if start is not None:
            out.append(c[start + 1 : i])
            start = None
        elif not before.isalpha() and after.isalnum():
            start = i
    return out


def sign_region(quote: str, caption: str) -> str | None:
    """The first quoted region the quote overlaps, or whose two or more content words it holds."""
    q = _bare(_normal(quote))
    if not q:
        return None
    have = set(_tokens(q))
    for region in quoted_regions(caption):
        r = _bare(region)
        if not r:
            continue
        content = content_words(r)
        if r in q or q in r or (len(content) >= 2 and all(w in have for w in content)):
            return region
    return None


def sign_region_of(quote: Column, caption: Column) -> Column:
    def run(quotes: pd.Series, captions: pd.Series) -> pd.Series:
        return pd.Series([sign_region(q or "", c or "") for q, c in zip(quotes, captions)], dtype=object)

    return F.pandas_udf(run, "string")(quote, caption)


def quoted_regions_of(caption: Column) -> Column:
    def run(captions: pd.Series) -> pd.Series:
        return captions.map(lambda c: quoted_regions(c or ""))

    return F.pandas_udf(run, "array<string>")(caption)


def parse_findings(answer: Column) -> Column:
    """Findings of a model's JSON answer, perhaps fenced: those of unknown kind or without both quotes are skipped, a
    missing note becomes ''.  Null and unreadable answers give an empty array."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    got = F.from_json(body, f"findings {FINDINGS}")["findings"]
    ok = F.filter(F.coalesce(got, F.array().cast(FINDINGS)), lambda f: f["kind"].isin(*KINDS, "shared_category") & f["quoteA"].isNotNull() & f["quoteB"].isNotNull())
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.transform(ok, lambda f: F.struct(f["kind"].alias("kind"), f["quoteA"].alias("quoteA"), f["quoteB"].alias("quoteB"), no(f["explicitA"]).alias("explicitA"), no(f["explicitB"]).alias("explicitB"), F.coalesce(f["note"], F.lit("")).alias("note")))


def verify(findings: DataFrame) -> DataFrame:
    """Adds verifiedA/B and signA/B to findings (pairid, pos, kind, quoteA, quoteB, explicitA, explicitB, note,
    captionA, captionB)."""
    out = findings
    for s in "AB":
        out = out.withColumn(f"verified{s}", quote_matches(F.col(f"quote{s}"), F.col(f"caption{s}")))
        out = out.withColumn(f"sign{s}", F.when(F.col(f"verified{s}"), sign_region_of(F.col(f"quote{s}"), F.col(f"caption{s}"))))
    return out


def _tokset(c: Column) -> Column:
    return words(normalize_evidence(c))


def _content(c: Column) -> Column:
    return F.filter(_tokset(c), lambda t: (F.length(t) >= 3) & ~t.isin(*vocab.MESSAGE_STOP_WORDS))


def _has_any(c: Column, listed) -> Column:
    return F.arrays_overlap(_tokset(c), F.array(*map(F.lit, listed)))


def mentions_sign(c: Column) -> Column:
    t = _tokset(c)
    at = lambda i: F.coalesce(F.try_element_at(t, i), F.lit(""))
    board = F.exists(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda i: at(i).isin("sign", "signs") & ~F.when(i > 1, at(i - 1)).otherwise(F.lit("")).isin("peace", "hand") & (at(i + 1) != "of"))
    return board | _has_any(c, vocab.SIGN_NOUNS)


def is_interpretive(c: Column) -> Column:
    s = normalize_evidence(c)
    out = F.lit(False)
    for m in vocab.INTERPRETIVE_MARKERS:
        out = out | s.contains(m)
    return out


def stem_overlap(a: Column, b: Column) -> Column:
    """A shared content word, or a shared beginning of four letters; generic actions do not count."""
    keep = lambda c: F.filter(_content(c), lambda t: ~F.substring(t, 1, 4).isin(*vocab.GENERIC_ACTION_STEMS))
    heads = lambda c: F.transform(F.filter(keep(c), lambda t: F.length(t) >= 4), lambda t: F.substring(t, 1, 4))
    return F.arrays_overlap(keep(a), keep(b)) | F.arrays_overlap(heads(a), heads(b))


def clip(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def verdicts(verified: DataFrame) -> DataFrame:
    """(pairid, connected, confidence, relationship, kind): the strongest finding of each pair that passes the
    structural checks; equal confidence by kind, then by position.  Pairs without one are not connected."""
    sa, sb = F.col("signA").isNotNull(), F.col("signB").isNotNull()
    one = sa != sb
    message, scene = F.coalesce("signA", "signB", F.lit("")), F.when(sa, F.col("quoteB")).otherwise(F.col("quoteA"))
    grounded = (F.size(_content(message)) > 0) & ~mentions_sign(scene) & ~is_interpretive(scene)
    both, either = F.col("explicitA") & F.col("explicitB"), F.col("explicitA") | F.col("explicitB")
    flip = _has_any(F.col("quoteA"), vocab.DEPICTION_WORDS) != _has_any(F.col("quoteB"), vocab.DEPICTION_WORDS)
    plain = (
        F.when(F.col("kind") == "source_receiver", F.when(both, F.lit(0.95)).when(either, F.lit(0.75)).otherwise(F.lit(0.60)))
        .when(F.col("kind") == "same_subject_reversal", F.when(both, F.lit(0.80)).otherwise(F.lit(0.70)))
        .when((F.col("kind") == "real_vs_depicted") & flip, F.lit(0.90))
        .when(F.col("kind") == "gesture_echo", F.lit(0.70))
    )
    conf = F.when(sa & sb, F.lit(None)).when(one, F.when(grounded, F.when(stem_overlap(message, scene), F.lit(0.95)).otherwise(F.lit(0.75)))).otherwise(plain)
    scores = (F.col("kind") != "shared_category") & F.col("verifiedA") & F.col("verifiedB")
    kind = F.when(one, "text_vs_world").otherwise(F.col("kind"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    best = F.min(F.when(scores & conf.isNotNull(), F.struct((-conf).alias("c"), rank.alias("r"), "pos", kind.alias("k"))))
    types = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    got = verified.groupBy("pairid").agg(best.alias("b"))
    return got.select("pairid", F.col("b").isNotNull().alias("connected"), F.coalesce(-F.col("b")["c"], F.lit(0.0)).alias("confidence"), F.coalesce(types[F.col("b")["k"]], F.lit("none")).alias("relationship"), F.col("b")["k"].alias("kind"))


def clean_caption(answer: Column) -> Column:
    """A caption as a model gave it, cut at the first control mark."""
    return F.trim(F.split_part(answer, F.lit("<|im_"), F.lit(1)))


def strip_opener(caption: Column) -> Column:
    """Without an opening such as "The image shows", unless fewer than 20 characters would be left."""
    # The openings.
    one = r"The (?:photograph|image) (?:captures|depicts|shows|features|portrays|presents) |This (?:photograph|image) (?:captures|depicts|shows|features|portrays) "
    scene = r"The scene (?:unfolds with|unfolds in|unfolds on|unfolds|captures|depicts|shows) |This scene (?:captures|depicts|shows) "
    rest = F.regexp_replace(caption, f"^(?:{one}|{scene})", "")
    cut = F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 2**30))
    return F.when((rest != caption) & (F.length(rest) >= 20), cut).otherwise(caption)
