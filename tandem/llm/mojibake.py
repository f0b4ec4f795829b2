"""Garbled text: learn how bytes were misread from near-twins, then find and restore it everywhere.

Around every word with non-ASCII characters stands a window of five words.  Stripped of non-ASCII
characters, the window of a garbled text equals that of its clean twin, so the two meet in a join;
the characters between equal ASCII neighbours align.  What is learned from the aligned characters:

* readings of UTF-8 in a code page, where a run of characters stands for one; they are undone in all
  texts, as long as what comes out is made of characters that clean text of the collection uses;
* exchanges of one character for another, as one code page read in another gives: rarer windows are
  aligned with much more frequent ones, and exchanges that occur together make a table - completed from
  the code pages that explain it, or as it was seen where none does.  A word is restored by a table where
  the restored word is much more frequent than the word itself.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.runtime import spread, stage

NON_ASCII = r"[^\x00-\x7F]"
LOST = "�"
#: The hypotheses: code pages that UTF-8 bytes may have been read in.
READERS = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "cp1254", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "cp852")
#: ... and single-byte texts read in another page: (written, read).
SINGLE_BYTE = (("cp1252", "latin_1"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("cp1253", "cp1252"), ("koi8_r", "cp1251"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1250"))
CONTROLS = re.compile("[\x80-\x9f]")
HIGH = re.compile(r"[^\x00-\x7f]+")
BLANK = re.compile(r"[ \t\r\n]+")
#: ASCII that is neither letter nor digit.
OTHERS = bytes(b for b in range(128) if not chr(b).isalnum())


@dataclass(frozen=True)
class MojibakeParams:
    """words: window; least_ascii: ASCII letters and digits a stripped window must keep to be joined on;
    support: distinct windows that must speak for a misreading; alphabet: clean windows that must hold a
    character for it to count as one the collection uses; dominance: how many times more frequent the clean
    one of two windows or words must be where neither looks misread; letters: different exchanges that must
    be seen for a table of them; depth: how often over a run may have been misread; scripts: ranges of
    characters that are used together, with how many must be known for all to count as known."""

    words: int = 5
    least_ascii: int = 4
    support: int = 2
    alphabet: int = 2
    dominance: int = 3
    letters: int = 2
    depth: int = 4
    scripts: tuple[tuple[int, int, int], ...] = ((0xC0, 0xFF, 3), (0x2010, 0x203A, 3), (0x386, 0x3CE, 5), (0x401, 0x451, 5), (0x3041, 0x30FF, 5), (0x4E00, 0x9FFF, 20))


@lru_cache(None)
def _bytes_of(page: str) -> dict[str, int]:
    """Character to byte; bytes a page leaves undefined stand for the control character of their number."""
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(page)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    if page == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


@lru_cache(None)
def _chars_of(page: str) -> dict[int, str]:
    out = {}
    for ch, b in _bytes_of(page).items():
        out.setdefault(b, ch)
    return out


@lru_cache(None)
def _latin(page: str) -> bool:
    """Pages whose letters cannot be mistaken for runs of UTF-8: their two-byte sequences need a symbol second."""
    return page not in ("cp1251", "cp1253", "koi8_r", "cp866")


UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def misread(clean: str, written: str, read: str) -> str | None:
    """The clean characters as they look when their bytes in one encoding are read in another."""
    if written == "utf_8":
        raw = clean.encode("utf-8", "replace")
    else:
        table = _bytes_of(written)
        if any(c not in table for c in clean):
            return None
        raw = bytes(table[c] for c in clean)
    chars = _chars_of(read)
    return "".join(chars.get(b, chr(b)) for b in raw)


def explanations(garbled: str, clean: str) -> list[str]:
    """The misreadings, once or twice over, that turn ``clean`` into ``garbled``."""
    out = []
    for r in READERS:
        once = misread(clean, "utf_8", r)
        if once == garbled:
            out.append(f"utf_8>{r}")
        elif once and len(once) < len(garbled):
            for r2 in (r, *(x for x in ("cp1252", "latin_1") if x != r)):
                if misread(once, "utf_8", r2) == garbled:
                    out += [f"utf_8>{r}", f"utf_8>{r2}"]
    for w, r in SINGLE_BYTE:
        if misread(clean, w, r) == garbled:
            out.append(f"{w}>{r}")
    return out


def _reread_run(run: str, page: str, known: frozenset[str] | None) -> str:
    """A run of non-ASCII characters with the UTF-8 sequences in it decoded."""
    table = _bytes_of(page)
    raw = [table.get(c) for c in run]
    if len(raw) < 2 or None in raw and not _latin(page):
        return run
    data = bytes(b if b is not None else 0xFF for b in raw)
    out, at = [], 0
    for m in UTF8.finditer(data):
        ch = m.group().decode("utf-8")
        if known is not None and ch not in known:
            continue
        if known is None and not ch.isprintable() and not "\x80" <= ch <= "\xad":
            continue
        out.append(run[at : m.start()])
        out.append(ch)
        at = m.end()
    if not out:
        return run
    if not _latin(page) and sum(map(len, out[::2])) + len(run) - at:
        return run  # letters of such pages form words of their own: all of the run must decode
    return "".join(out) + run[at:]


@lru_cache(200_000)
def _odd_run(run: str) -> bool:
    return any(_reread_run(run, page, None) != run for page in READERS)


def suspicious(text: str) -> bool:
    """Before anything is learned: could some run be misread UTF-8, or does the text hold what no sound text holds."""
    if LOST in text or CONTROLS.search(text):
        return True
    return any(len(run) > 1 and _odd_run(run) for run in HIGH.findall(text))


def widen(known: set[str], scripts) -> frozenset[str]:
    """The characters seen in sound text, their other cases, and the rest of the scripts they come from."""
    out = known | {c for k in known for c in (k.upper(), k.lower()) if len(c) == 1}
    for lo, hi, least in scripts:
        if sum(lo <= ord(c) <= hi for c in known) >= least:
            out |= {chr(c) for c in range(lo, hi + 1) if chr(c).isprintable()}
    return frozenset(out)


@dataclass(frozen=True)
class Learned:
    """pages: code pages UTF-8 was misread in, best supported first; known: characters of sound text;
    controls: whether control characters stand for the signs of cp1252; tables: exchanges of characters
    (garbled: written) with their names; depth: how often over a run may have been misread; words: the words to
    exchange; most_held: how many of them tasks hold at most, more being joined."""

    pages: tuple[str, ...]
    known: frozenset[str]
    controls: bool
    tables: tuple[tuple[str, dict[str, str]], ...] = ()
    depth: int = 4
    words: DataFrame | None = field(default=None, compare=False)
    most_held: int = 100_000

    def _run(self, run: str) -> str:
        """A run with the misreadings undone: twice over where only that gives known characters, else once."""
        for page in self.pages:
            once = _reread_run(run, page, None)
            if once == run:
                continue
            for again in self.pages:
                twice = self._deepest(once, again)
                if twice != once and self.known.issuperset(twice):
                    return twice
        for page in self.pages:
            run = _reread_run(run, page, self.known)
        return run

    def _deepest(self, run: str, page: str) -> str:
        for _ in range(self.depth - 1):
            was, run = run, _reread_run(run, page, self.known)
            if run == was:
                break
        return run

    def repairer(self):
        plain = Learned(self.pages, self.known, self.controls, depth=self.depth)  # what the tasks need
        cached = lru_cache(200_000)(plain._run)

        def repair(text: str) -> str:
            text = HIGH.sub(lambda m: cached(m.group()) if len(m.group()) > 1 else m.group(), text)
            if plain.controls and CONTROLS.search(text):
                chars = _chars_of("cp1252")
                text = CONTROLS.sub(lambda m: chars.get(ord(m.group()), m.group()), text)
            return text

        return repair


def _windows(p: MojibakeParams):
    half = p.words // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, wins, mids = [], [], []
            for text in b.column(0).to_pylist():
                words = BLANK.split(text)
                for i, w in enumerate(words):
                    if not w.isascii():
                        win = " ".join(words[max(0, i - half) : i + half + 1])
                        key = win.encode("ascii", "ignore")
                        keys.append(key.decode() if len(key.translate(None, OTHERS)) >= p.least_ascii else None)
                        wins.append(win)
                        mids.append(min(i, half))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(wins, pa.string()), pa.array(mids, pa.int32())], names=["key", "win", "mid"])

    return run


def _aligned(garbled: str, clean: str, same: bool = False) -> Iterator[tuple[str, str]]:
    """The differing runs (with ``same`` also the equal ones) between equal ASCII characters of two windows whose
    stripped forms are equal."""
    a, b = re.split(r"([\x00-\x7f])", garbled), re.split(r"([\x00-\x7f])", clean)
    if len(a) == len(b):
        yield from ((x, y) for x, y in zip(a[::2], b[::2]) if (x != y or same) and x and y)


def twins(docs: DataFrame, p: MojibakeParams) -> tuple[DataFrame, DataFrame]:
    """(windows, twins): all distinct windows, and each suspicious one with its most frequent clean twin."""
    texts = spread(docs.filter(F.col("text").rlike(NON_ASCII)).select("text"))
    found = texts.mapInArrow(_windows(p), "key string, win string, mid int")
    counted = found.groupBy("key", "win", "mid").agg(F.count("*").alias("n"))

    def mark(batches):
        for b in batches:
            sus = [suspicious(w) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sus, pa.bool_())], names=[*b.schema.names, "sus"])

    windows = stage(counted.mapInArrow(mark, "key string, win string, mid int, n long, sus boolean"), "windows")
    # one clean window a key, so that the join is many to one however many records share the key
    clean = windows.filter("NOT sus AND key IS NOT NULL").groupBy("key", "mid").agg(F.max_by("win", F.struct("n", "win")).alias("clean"))
    both = windows.filter("sus AND key IS NOT NULL").select("key", "mid", F.col("win").alias("garbled"), "n").join(clean, ["key", "mid"])
    return windows, both


def exchanges(windows: DataFrame, p: MojibakeParams) -> DataFrame:
    """(g, c, n, strong): single characters that stand in rare windows where much more frequent windows of the same
    stripped text have a letter c, with the windows that show it and those that show others as well and hold no
    non-ASCII letter that agrees."""
    sound = windows.filter("NOT sus AND key IS NOT NULL")
    clean = sound.groupBy("key", "mid").agg(F.max_by("win", F.struct("n", "win")).alias("clean"), F.max("n").alias("often"))
    rare = sound.join(clean, ["key", "mid"]).filter((F.col("win") != F.col("clean")) & (F.col("n") * p.dominance <= F.col("often")))

    def align(batches):
        for b in batches:
            got = []
            for g, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                runs = list(_aligned(g, c, True))
                if not runs or any(len(x) != len(y) for x, y in runs):
                    continue
                pairs = {(u, v) for x, y in runs for u, v in zip(x, y) if u != v and v.isalpha()}
                same = any(u == v and u.isalpha() for x, y in runs for u, v in zip(x, y))
                got += [(u, v, len(pairs) > 1 and not same) for u, v in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["g", "c", "strong"])

    seen = rare.select("win", "clean").mapInArrow(align, "g string, c string, strong boolean")
    return seen.groupBy("g", "c").agg(F.count("*").alias("n"), F.count_if("strong").alias("strong"))


def tables_of(seen: list[tuple[str, str, int, int]], pages: Iterator[str], p: MojibakeParams) -> list[tuple[str, dict[str, str]]]:
    """The tables that explain the exchanges seen (g, c, n, strong), best supported first.

    A code page read in another counts if it explains enough different letters; what no page explains makes a table
    as it is, of the characters that were exchanged together with others and nearly always for the same one.
    Letters of UTF-8 that lost their second half, a no-break space, to a plain space belong to the pages given."""
    left = {(g, c): (n, strong) for g, c, n, strong in seen}
    out: list[tuple[str, dict[str, str]]] = []
    while left:
        why = {h: [gc for gc in left if misread(gc[1], *h) == gc[0]] for h in SINGLE_BYTE}
        best = max(SINGLE_BYTE, key=lambda h: (sum(left[gc][0] for gc in why[h]), -SINGLE_BYTE.index(h)))
        if len({g for g, _ in why[best]}) < p.letters or sum(left[gc][0] for gc in why[best]) < p.support:
            break
        whole = {misread(c, *best): c for c in _bytes_of(best[0]) if c.isalpha()}
        out.append((">".join(best), {g: c for g, c in whole.items() if g != c and g > "\x7f"}))
        left = {gc: n for gc, n in left.items() if gc not in why[best]}
    votes: dict[str, int] = {}
    for (g, _), (n, _) in left.items():
        votes[g] = votes.get(g, 0) + n
    free = {g: c for (g, c), (n, strong) in sorted(left.items()) if strong >= p.support and n * 5 >= votes[g] * 4}
    if len(free) >= p.letters:
        out.append(("as seen", free))
    for page in pages:
        letters = (chr(c) for c in range(0xC0, 0x530) if chr(c).isalpha())
        halves = {m[0]: c for c in letters for m in [misread(c, "utf_8", page)] if len(m) == 2 and m[1] == "\xa0" and m[0] > "\x7f"}
        if halves:
            out.append((f"utf_8>{page} less its blank", halves))
    return out


def _core(word: str) -> str:
    return word.strip(string.punctuation)


def word_fixes(windows: DataFrame, tables: list[tuple[str, dict[str, str]]], p: MojibakeParams) -> DataFrame:
    """(word, fixed): the words some table turns into one that is ``dominance`` times as frequent and seen ``support``
    times at least; of several the most frequent.  Every word with a non-ASCII character has its own windows."""
    word = F.btrim(F.element_at(F.split("win", " "), F.col("mid") + 1), F.lit(string.punctuation))
    words = stage(windows.select(word.alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")), "words")

    def attempt(batches):
        for b in batches:
            got = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                odd = {ch for ch in w if ch > "\x7f"}
                for _, t in tables:
                    if odd & t.keys():
                        got.append((w, n, "".join(t.get(ch, ch) for ch in w)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["word", "n", "fixed"])

    tried = words.mapInArrow(attempt, "word string, n long, fixed string")
    held = words.select(F.col("word").alias("fixed"), F.col("n").alias("often"))
    sure = tried.join(held, "fixed").filter((F.col("often") >= p.support) & (F.col("often") >= p.dominance * F.col("n")))
    return sure.groupBy("word").agg(F.max_by("fixed", F.struct("often", "fixed")).alias("fixed"))


def _swapped(text: str, table: dict[str, str]) -> str:
    """The text with the words of the table exchanged, punctuation around them kept."""
    plain = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    if not any(_core(w) in table for w in plain.split(" ") if not w.isascii()):
        return text
    return "".join(x.replace(_core(x), table[_core(x)]) if _core(x) in table else x for x in re.split(f"({BLANK.pattern})", text))


def fix_words(docs: DataFrame, fixes: DataFrame) -> DataFrame:
    """``docs`` with ``text`` restored word by word and ``exchanged``, whether that changed it; by a join, for fixes of
    any number."""

    def list_words(batches):
        for b in batches:
            keys, words = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {w for w in map(_core, BLANK.split(text)) if not w.isascii()}
                keys += [k] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], names=["th", "word"])

    texts = docs.filter(F.col("text").rlike(NON_ASCII)).select(F.xxhash64("text").alias("th"), "text")
    # a text has as many swaps as it has words at most; equal texts share theirs
    swaps = texts.mapInArrow(list_words, "th long, word string").join(fixes, "word").groupBy("th").agg(F.map_from_entries(F.collect_set(F.struct("word", "fixed"))).alias("swaps"))

    def mend(batches):
        at = None
        for b in batches:
            at = b.schema.get_field_index("text")
            out, hit = [], []
            for text, swap in zip(b.column(at).to_pylist(), b.column(b.schema.get_field_index("swaps")).to_pylist()):
                new = _swapped(text, dict(swap)) if swap else text
                out.append(new)
                hit.append(new != text)
            cols = [b.column(i) if i != at else pa.array(out, pa.string()) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(hit, pa.bool_())], names=[*b.schema.names[:-1], "exchanged"])

    names = docs.columns
    joined = docs.withColumn("th", F.xxhash64("text")).join(swaps, "th", "left").select(*names, "swaps")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return joined.mapInArrow(mend, f"{fields}, exchanged boolean")


def learn(docs: DataFrame, p: MojibakeParams | None = None) -> tuple[Learned, DataFrame, DataFrame]:
    """(learned, report, twins) from a table with a ``text`` column.

    The report has one row for each set of misreadings that explain the same alignments.  What comes to
    the driver is bounded by the list of hypotheses and by the number of Unicode characters."""
    p = p or MojibakeParams()
    windows, both = twins(docs, p)

    def explain(batches):
        for b in batches:
            names, keys = [], []
            for k, g, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for x, y in _aligned(g, c):
                    why = sorted(set(explanations(x, y))) or ([f"lost>{LOST}"] if LOST in x else [])
                    if why:
                        names.append(" ".join(why))
                        keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.string())], names=["misreadings", "key"])

    seen = both.select("key", "garbled", "clean").mapInArrow(explain, "misreadings string, key string")
    report = stage(seen.distinct().groupBy("misreadings").agg(F.count("*").alias("support")), "misreadings")
    left = {r.misreadings: r.support for r in report.collect()}
    order = [f"utf_8>{r}" for r in READERS] + [f"{w}>{r}" for w, r in SINGLE_BYTE]
    chosen: list[str] = []
    while left:
        # the hypothesis that explains most of what is still unexplained
        score = {h: sum(n for names, n in left.items() if h in names.split()) for h in order}
        best = max(order, key=lambda h: (score[h], -order.index(h)))
        # control characters never belong to a text, so one window is enough to tell what they stand for
        if score[best] < (1 if best == "cp1252>latin_1" else p.support):
            break
        chosen.append(best)
        left = {names: n for names, n in left.items() if best not in names.split()}

    def letters(batches):
        for b in batches:
            pairs = [(c, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in set(w) if c > "\x7f"]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], names=["c", "n"])

    used = windows.filter("NOT sus").select("win", "n").mapInArrow(letters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.alphabet)
    known = widen({r.c for r in used.collect()}, p.scripts)
    pages = tuple(h.split(">")[1] for h in chosen if h.startswith("utf_8>"))
    # pairs of characters with enough windows: bounded by the alphabets in use
    seen = [tuple(r) for r in exchanges(windows, p).filter(F.col("n") >= p.support).collect()]
    tables = tables_of(seen, pages, p)
    fixes = stage(word_fixes(windows, tables, p), "fixes") if tables else None
    return Learned(pages, known, "cp1252>latin_1" in chosen, tuple(tables), p.depth, fixes), report, both


def judged(docs: DataFrame, learned: Learned, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, garbled, restored): for every row with a non-ASCII character whether it holds garbled ones, and
    the text with what can be undone undone (null for sound rows).  Null, empty and pure ASCII texts are
    sound and give no row; copies and rows without id are judged like any other."""
    rows = docs.filter(F.col("text").rlike(NON_ASCII)).select(F.col(id_col).alias("doc_id"), "text")
    repair_of = Learned(learned.pages, learned.known, learned.controls, depth=learned.depth)
    held: dict[str, str] = {}
    if learned.words is not None and learned.words.limit(learned.most_held + 1).count() <= learned.most_held:
        held = {r.word: r.fixed for r in learned.words.collect()}
        rows = rows.withColumn("exchanged", F.lit(False))
    else:
        rows = fix_words(rows, learned.words) if learned.words is not None else rows.withColumn("exchanged", F.lit(False))
    # at most most_held words; more are joined above instead
    swaps = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        repair = repair_of.repairer()
        for b in batches:
            bad, out = [], []
            for text, exchanged in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                fixed = repair(_swapped(text, swaps.value) if swaps.value else text)
                garbled = exchanged or fixed != text or LOST in text or CONTROLS.search(text) is not None
                bad.append(garbled)
                out.append(fixed if garbled else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bad, pa.bool_()), pa.array(out, pa.string())], names=["doc_id", "garbled", "restored"])

    return spread(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, garbled boolean, restored string")


def restore_lost(rows: DataFrame, both: DataFrame, p: MojibakeParams | None = None) -> DataFrame:
    """``rows`` (doc_id, restored) with words that hold a replacement character exchanged for the word at their
    place in the clean twin of their window, or else for the only clean word twins know for them anywhere;
    other words stay."""
    half = (p or MojibakeParams()).words // 2
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pairs(batches):
        for b in batches:
            got = []
            for key, mid, g, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                a, z = g.split(" "), c.split(" ")
                if len(a) == len(z) and LOST in a[mid] and LOST not in z[mid]:
                    got.append((key, mid, a[mid], z[mid]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["key", "mid", "word", "clean"])

    known = stage(both.filter(F.col("garbled").contains(LOST)).select("key", "mid", "garbled", "clean").mapInArrow(pairs, "key string, mid int, word string, clean string"), "lostwords")
    here = known.groupBy("key", "mid", "word").agg(F.min("clean").alias("here"))
    anywhere = known.groupBy("word").agg(F.min("clean").alias("anywhere"), F.max("clean").alias("other")).filter("anywhere = other").drop("other")
    lost = stage(rows.filter(F.col("restored").contains(LOST)).select("doc_id", "restored"), "lost")

    def places(batches):
        for b in batches:
            got = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = BLANK.split(text)
                for i, w in enumerate(words):
                    if LOST in w:
                        win = " ".join(words[max(0, i - half) : i + half + 1])
                        got.append((d, i, HIGH.sub("", win), min(i, half), w))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], b.schema.field(0).type), *(pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.string()), 1))], names=["doc_id", "i", "key", "mid", "word"])

    asked = lost.mapInArrow(places, f"doc_id {kind}, i int, key string, mid int, word string")
    new = asked.join(here, ["key", "mid", "word"], "left").join(anywhere, "word", "left").select("doc_id", "i", F.coalesce("here", "anywhere").alias("new")).filter("new IS NOT NULL")
    swaps = new.groupBy("doc_id").agg(F.collect_list(F.struct("i", "new")).alias("swaps"))

    def mend(batches):
        for b in batches:
            out = []
            for text, swap in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts = re.split(f"({BLANK.pattern})", text)
                for s in swap or ():
                    parts[2 * s["i"]] = s["new"]
                out.append("".join(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "restored"])

    mended = lost.join(swaps, "doc_id", "left").select("doc_id", "restored", "swaps").mapInArrow(mend, f"doc_id {kind}, restored string")
    return rows.filter(~F.col("restored").contains(LOST)).select("doc_id", "restored").unionByName(mended)
