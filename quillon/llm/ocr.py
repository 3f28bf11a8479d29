"""Continuous paragraphs from the lines of scanned pages.

A hidden Markov model labels the lines of a page as furniture (headers, footers,
page numbers), body, or break (a body line that begins a paragraph); blank lines
are their own state. Its start, transition and emission probabilities are counted
on a bounded sample of accepted pages (FIT_PAGES), whose lines are aligned with
the reviewer's text; emissions are independent layout features. The same
alignment gives the character confusions of the scans. Words are then judged
against the vocabulary of all pages: a word is misread if undoing a confusion
gives a word so much more frequent that its own count is what the confusion
explains, or if digits stand within letters or letters within a number. A line's
last word is broken if a hyphenation mark or the vocabulary says that it goes on
in the next body line, if need be on the next page of the scan.

Defined cases: null and empty pages have no lines of any kind; CRLF counts as a
line end; repeated pages are labelled each; without accepted pages the model
falls back to add-one counts and the listed confusions; a hyphen before a missing
next page is taken for a broken word; texts of any length are read whole.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import runtime as rt

#: Bounds of the fitting sample, in pages and characters, and of the words it declares common.
FIT_PAGES, FIT_CHARS = 1500, 40_000_000
COMMON = 50_000
FURNITURE, BODY, BREAK, BLANK = range(4)
MARKS = "-‐­¬"
#: Mark of words that end or begin a line and so may be parts of one.
EDGE = "|"
#: A word without hyphen is broken if it is so many times as frequent as its rarer part is within lines.
PART_RATIO = 3
WORD = re.compile(r"[^\W_]+(?:['’ʼ-][^\W_]+)*")
LAST = re.compile(rf"({WORD.pattern})([{MARKS}]?)[ \t]*$")
FIRST = re.compile(rf"^[ \t]*({WORD.pattern})")
# Usual confusions of recognisers, wrong:right.
CONFUSIONS = "rn:m cl:d vv:w ii:u c:e 0:o 0:о 1:l j:i f:t 9:g 4:ч 3:з 6:б l:1 I:1 O:0 S:5 B:8 г:т с:е н:и и:н п:л ьі:ы b:h u:a".split()
NUMBER_LETTERS = "IlOoSBОоЗбі|"
ROMAN = [(50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
FIXED = str.maketrans("IlOoSBОоЗі|", "11005800311")


def roman(n: int) -> str:
    out = ""
    for value, sign in ROMAN:
        while n >= value:
            out, n = out + sign, n - value
    return out


@lru_cache(maxsize=20_000)
def letter_pairs(s: str) -> frozenset[str]:
    return frozenset(map("".join, zip(s, s[1:], strict=False)))


def similar(a: str, b: str) -> float:
    """Share of common letter pairs."""
    x, y = letter_pairs(a), letter_pairs(b)
    return 2 * len(x & y) / max(1, len(x) + len(y))


def shape(line: str, page: int | None, titles: list[str], pack: str | None) -> str:
    """What kind of text an edge line holds: page number, title, pack name, number or other text."""
    low = " ".join(line.lower().split())
    numbers = {re.sub(r"^0+(?=\d)", "", w.translate(FIXED)) for w in re.findall(r"\w+", line) if any(c.isdigit() or c in NUMBER_LETTERS for c in w)}
    words = re.findall(r"[^\W\d_]{2,}", line)
    if page is not None and (str(page) in numbers or low.strip(" .-–—[]()") == roman(page)) and len(words) <= 3 and len(line) < 30:
        return "pageno"
    core = re.sub(r"^[\s\d]+|[\s…\d.]+$", "", low)
    for t in titles:
        if len(core) >= 5 and len(core) < 2 * len(t) and (similar(core, t) > 0.7 or "…" in low and len(core) > 10 and similar(core, t[: len(core)]) > 0.75):
            return "title"
    if pack and (pack.lower() in low or similar(re.split(r"\s[·|]\s", low)[0], pack.lower()) > 0.75):
        return "pack"
    if not words:
        return "number" if any(c.isdigit() for c in line) else "signs"
    return "text"


def observations(lines: list[str], page: int | None, titles: list[str], pack: str | None) -> list[tuple | None]:
    """Layout features of every line; None for blank lines."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    width = max((len(lines[i]) for i in filled), default=1)
    known = [" ".join(t.lower().split()) for t in titles if t]
    out: list[tuple | None] = [None] * len(lines)
    for k, i in enumerate(filled):
        line = lines[i].strip()
        top, bottom = min(k, 3), min(len(filled) - 1 - k, 3)
        kind = shape(line, page, known, pack) if k < 3 or bottom < 3 else "inner"
        before = lines[filled[k - 1]].strip() if k else ""
        out[i] = (
            f"{top}{kind}",
            f"{bottom}{kind}",
            "caps" if len(line) > 4 and line.isupper() else "low" if line[0].islower() else "up" if line[0].isupper() else "other",
            "none" if not before else "stop" if before[-1] in ".!?:»\")" else "open",
            "gap" if i and not lines[i - 1].strip() else "tight",
            "none" if not before else "short" if len(before) < 0.8 * width else "full",
            "short" if len(line) < 0.8 * width else "full",
        )
    return out


def align(lines: list[str], text: str) -> list[tuple[int, str, int]]:
    """(state, repaired form without spaces, its place in the text without spaces) of every line of an accepted page."""
    squeeze = lambda s: re.sub(r"\s+", "", s)
    starts, flat = set(), ""
    for part in re.split(r"\n\s*\n", text):
        starts.add(len(flat))
        flat += squeeze(part)
    out, at = [], 0
    for line in lines:
        bare = squeeze(line).rstrip(MARKS)
        if not bare:
            out.append((BLANK, "", at))
            continue
        begin = at + 1 if flat[at : at + 1] in tuple(MARKS) and bare[0] not in MARKS else at
        if flat.startswith(bare, begin):
            size, score = len(bare), 1.0
        else:
            window = flat[begin : begin + len(bare) + 8]
            blocks = difflib.SequenceMatcher(None, bare, window, autojunk=False).get_matching_blocks()
            i, j, n = blocks[-2] if len(blocks) > 1 else (0, 0, 0)
            size = min(len(window), j + n + len(bare) - i - n)  # what follows the last common part was misread
            score = 2 * sum(x.size for x in blocks) / max(1, len(bare) + size)
        if score < 0.75 or len(bare) < 4 and score < 1:
            out.append((FURNITURE, "", at))
            continue
        out.append((BREAK if begin in starts else BODY, flat[begin : begin + size], begin))
        at = begin + size
    return out


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: list[dict[str, np.ndarray]]
    unseen: list[np.ndarray]
    confusions: dict[str, list[tuple[str, float]]]  # wrong: (right, rate per occurrence of right)
    common: frozenset = field(default_factory=frozenset)
    seen: dict = field(default_factory=dict)

    def emission(self, o: tuple) -> list[float]:
        """Log probabilities of a line's features in furniture, body and break."""
        known = self.seen.get(o)
        if known is None:
            known = self.seen[o] = list(sum((self.emit[k].get(v, self.unseen[k]) for k, v in enumerate(o)), np.zeros(4))[:BLANK])
        return known

    def label(self, seen: list[tuple | None]) -> list[int]:
        """Most likely states of a page's lines (Viterbi; a blank line has one state, other lines three)."""
        if not seen:
            return []
        start, move = self.start.tolist(), self.move.tolist()
        before: list[tuple[int, float]] = []
        back: list[dict[int, int]] = []
        for o in seen:
            options = [(BLANK, 0.0)] if o is None else list(enumerate(self.emission(o)))
            if not before:
                now, links = [(s, start[s] + e) for s, e in options], {}
            else:
                now, links = [], {}
                for s, e in options:
                    best, via = max([(p + move[q][s], q) for q, p in before])
                    now.append((s, best + e))
                    links[s] = via
            back.append(links)
            before = now
        path = [max(before, key=lambda x: x[1])[0]]
        for links in reversed(back[1:]):
            path.append(links[path[-1]])
        return path[::-1]


def fit(pages: list[tuple]) -> Model:
    """Model from (lines, text, page, titles, pack) of accepted pages."""
    start, move = np.ones(4), np.ones((4, 4))
    emit: list[dict[str, np.ndarray]] = [{} for _ in range(7)]
    totals = np.ones(4)
    wrongs, rights, words = Counter(), Counter(), Counter()
    # one typical page of prior counts: a title on top, text, a page number at the bottom
    start[FURNITURE] += 1
    for state, values in ((FURNITURE, ("0title", "3title")), (FURNITURE, ("3pageno", "0pageno")), (BODY, ("3inner", "3inner"))):
        for k, v in enumerate(values):
            emit[k].setdefault(v, np.full(4, 0.1))[state] += 1
        totals[state] += 1
    for lines, text, page, titles, pack in pages:
        aligned = align(lines, text)
        words.update(WORD.findall(text))
        rights.update(text)
        before = None
        for (state, repaired, _), line, seen in zip(aligned, lines, observations(lines, page, titles, pack), strict=True):
            if before is None:
                start[state] += 1
            else:
                move[before, state] += 1
            before = state
            if seen is not None:
                totals[state] += 1
                for k, v in enumerate(seen):
                    emit[k].setdefault(v, np.full(4, 0.1))[state] += 1
            if state in (BODY, BREAK):
                own = re.sub(r"\s+", "", line).rstrip(MARKS)
                for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, own, repaired, autojunk=False).get_opcodes():
                    if tag == "replace" and i2 - i1 <= 2 and j2 - j1 <= 2 and own[i1:i2].isalnum() and repaired[j1:j2].isalnum():
                        wrongs[own[i1:i2], repaired[j1:j2]] += 1
    for pair in CONFUSIONS:
        wrong, right = pair.split(":")
        wrongs[wrong, right] += 1
    confusions: dict[str, list[tuple[str, float]]] = {}
    for (wrong, right), n in wrongs.items():
        if n >= 2 or f"{wrong}:{right}" in CONFUSIONS:
            seen_right = text_count(rights, right)
            confusions.setdefault(wrong, []).append((right, n / max(50.0, seen_right)))
    log_emit = [{v: np.log(c / (totals + 1)) for v, c in e.items()} for e in emit]
    unseen = [np.log(0.1 / (totals + 1)) for _ in emit]
    common = frozenset(w for w, n in words.most_common(COMMON) if n >= 3)
    return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), log_emit, unseen, confusions, common)


def text_count(counts: Counter, s: str) -> float:
    """Occurrences of a character, or an upper bound for a pair of characters."""
    return float(min(counts[c] for c in s))


MIXED = re.compile(r"\d[^\W\d_]|[^\W\d_]\d")


def repairs(word: str, confusions: dict[str, list[tuple[str, float]]]) -> dict[str, float]:
    """Forms with one confusion undone (or the same one everywhere, or two) and the rate of the confusion."""
    out: dict[str, float] = {}

    def put(form: str, rate: float) -> None:
        if form != word:
            out[form] = max(out.get(form, 0.0), rate)

    singles = []
    for wrong, options in confusions.items():
        at = word.find(wrong)
        while at >= 0:
            for right, rate in options:
                form = word[:at] + right + word[at + len(wrong) :]
                put(form, rate)
                singles.append((form, rate))
                put(word.replace(wrong, right), rate)
            at = word.find(wrong, at + 1)
    if any(c.isdigit() for c in word) and len(word) > 2:
        for form, rate in singles:
            for wrong, options in confusions.items():
                if wrong[0].isdigit() and wrong in form:
                    for right, other in options:
                        put(form.replace(wrong, right), rate * max(other, 1e-3))
    return out


def odd_number(word: str) -> bool:
    """A number with letters that stand for digits."""
    return any(c.isdigit() for c in word) and not word.isdigit() and all(c.isdigit() or c in NUMBER_LETTERS for c in word)


def digits_inside(word: str) -> bool:
    """Letters with a digit before one of them."""
    return bool(re.search(r"[^\W\d_]\d+[^\W\d_]|^\d[^\W\d_]{3,}", word)) and sum(c.isalpha() for c in word) >= 2


PAGES = "candidate_no long, originaltext string, page int, document_title string, pack_title string, pack_id string, source_path string"
EVENTS = "kind string, candidate_no long, line_no int, a string, b string, mark string, path string, page int, n long"
_names = ["kind", "candidate_no", "line_no", "a", "b", "mark", "path", "page", "n"]
_types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()]


def lines_of(text: str | None) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n")] if text else []


def plain_title(lines: list[str], states: list[int], title: str) -> int | None:
    """The last of the three top lines that is furniture and just the document's title, without number and not in capitals."""
    known = " ".join(title.lower().split())
    top = [i for i, x in enumerate(lines) if x.strip()][:3]
    for i in reversed(top):
        low = " ".join(lines[i].lower().split())
        if states[i] == FURNITURE and not lines[i].isupper() and "…" not in low and not re.search(r"^\d|\d$", low) and similar(low, known) > 0.8:
            return i
    return None


def page_events(no: int, text: str | None, page: int | None, titles: list[str], pack: str | None, path: str | None, model: Model, counts: Counter) -> Iterator[tuple]:
    """What one page tells: furniture and break lines, possible word breaks, words that are not common."""
    lines = lines_of(text)
    states = model.label(observations(lines, page, titles, pack))
    body = [i for i, s in enumerate(states) if s in (BODY, BREAK)]
    heading = plain_title(lines, states, titles[0])
    for i, s in enumerate(states):
        if s == FURNITURE and i != heading:
            yield ("f", no, i + 1, None, None, None, None, None, None)
        elif s == BREAK:
            yield ("p", no, i + 1, None, None, None, None, None, None)
    if heading is not None:  # on the scan's first page this is a heading of the text
        yield ("x", no, heading + 1, None, None, None, path, page, None)
    begun = False
    for k, i in enumerate(body):
        line = lines[i]
        words = WORD.findall(line)
        tail = line.rsplit(None, 1)
        last = LAST.search(tail[-1]) if tail else None
        marked = bool(last and last[2])
        following = FIRST.match(lines[body[k + 1]]) if k + 1 < len(body) else None
        for j, w in enumerate(words):
            if j == 0 and begun or marked and j == len(words) - 1:
                continue
            edge = EDGE if j == 0 or last and j == len(words) - 1 else None
            if w in model.common:
                counts[w, edge] += 1
            else:
                yield ("t", no, i + 1, w, None, edge, None, None, None)
        begun = marked
        if last and last[1][-1].isalpha():
            left, mark = last[1], last[2]
            if k + 1 == len(body):
                if mark or left not in model.common:
                    yield ("l", no, i + 1, left, None, mark, path, page, None)
            elif following and (mark or (following[1][0].islower() and not (left in model.common and following[1] in model.common))):
                yield ("h", no, i + 1, left, following[1], mark, None, None, None)
    if body and (m := FIRST.match(lines[body[0]])):
        yield ("1", no, body[0] + 1, m[1], None, None, path, page, None)


def events(pages: DataFrame, model: Model) -> DataFrame:
    sent = pages.sparkSession.sparkContext.broadcast(model)  # bounded by COMMON words and the features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            counts: Counter = Counter()
            rows: list[tuple] = []
            for no, text, page, title, pack_title, pack, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += page_events(no, text, page, [title or "", pack_title or ""], pack, path, m, counts)
            rows += [("w", None, None, w, None, edge, None, None, n) for (w, edge), n in counts.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _types, strict=True)], names=_names)

    return rt.spread(pages, "candidate_no").mapInArrow(run, EVENTS)


def vocabulary(ev: DataFrame) -> DataFrame:
    """(word, n, inner) over all pages: occurrences, and those of them that no line break touches."""
    words = ev.where("kind in ('w', 't')").select(F.col("a").alias("word"), F.coalesce("n", F.lit(1)).alias("n"), "mark")
    return words.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("mark").isNull(), F.col("n")).otherwise(0)).alias("inner"))


def misread_words(ev: DataFrame, vocab: DataFrame, model: Model) -> DataFrame:
    """(word, repaired): words that are not common and are misread, with the likeliest right form (null if unknown)."""
    spark = ev.sparkSession
    sent = spark.sparkContext.broadcast(model.confusions)
    known = spark.createDataFrame([(w,) for w in sorted(model.common)] or [("",)], "word string")  # at most COMMON words
    rare = vocab.select("word", "n").join(F.broadcast(known), "word", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sure = odd_number(word) or digits_inside(word)
                forms = repairs(word, sent.value) if len(word) > 1 and not word.isdigit() else {}
                if sure and not forms:
                    forms = {"": 0.0}
                for form, rate in forms.items():
                    rows.append((word, n, form, rate, sure))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.bool_()], strict=True)],
                names=["word", "n", "form", "rate", "sure"],
            )

    forms = rare.mapInArrow(run, "word string, n long, form string, rate double, sure boolean")
    judged = forms.join(vocab.select(F.col("word").alias("form"), F.col("n").alias("form_n")), "form", "left")
    times = F.coalesce("form_n", F.lit(0))
    explained = (times >= 3) & (times > 2 * F.col("n")) & ((times >= 15 * F.col("n")) | (F.col("n") <= 10 * times * F.col("rate") + 1)) & (F.length("word") >= 3)
    best = judged.where(explained | F.col("sure")).groupBy("word").agg(F.max(F.struct(times.alias("n"), F.when(times > 0, F.col("form")).alias("form"))).alias("best"))
    return best.select("word", F.col("best.form").alias("repaired"))


def small_join(many: DataFrame, one: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join of occurrences with judged words: broadcast if these were measured small, else with hot words spread over tasks."""
    return many.join(F.broadcast(one), keys, how) if rt.fits_broadcast(one) else rt.skew_join(many, one, keys, how)


def broken_lines(ev: DataFrame, vocab: DataFrame) -> DataFrame:
    """(candidate_no, line_no) of the lines whose last word goes on in the next body line and is written without a hyphen."""
    first = ev.where("kind = '1'").groupBy("path", F.col("page").alias("next_page")).agg(F.min(F.struct("candidate_no", "a")).getField("a").alias("b"))
    last = ev.where("kind = 'l'").select("candidate_no", "line_no", "a", "mark", "path", (F.col("page") + 1).alias("next_page"))
    across = last.join(first, ["path", "next_page"], "left").select("candidate_no", "line_no", "a", "b", "mark")
    every = ev.where("kind = 'h'").select("candidate_no", "line_no", "a", "b", "mark").unionByName(across)
    soft = F.col("mark").isin("‐", "­", "¬")
    # of many lines with the same fragments one is looked up
    open_cases = every.where(~soft & F.col("b").isNotNull()).select("a", "b", F.coalesce("mark", F.lit("")).alias("mark")).distinct()
    count_of = lambda name, n="n": vocab.select(F.col("word").alias(name), F.col(n).alias(f"{name}_n"))
    looked = (
        open_cases.withColumn("joined", F.concat("a", "b")).withColumn("kept", F.concat("a", F.lit("-"), "b"))
        .join(count_of("joined"), "joined", "left").join(count_of("kept"), "kept", "left")
        .withColumn("left_word", F.col("a")).withColumn("right_word", F.col("b"))
        .join(count_of("left_word", "inner"), "left_word", "left").join(count_of("right_word", "inner"), "right_word", "left")
    )
    j, k = F.coalesce("joined_n", F.lit(0)), F.coalesce("kept_n", F.lit(0))
    lower = F.substring("b", 1, 1) == F.lower(F.substring("b", 1, 1))
    # fragments of unmarked breaks stand at line breaks only, so these occurrences say nothing about their being words
    rarer_part = F.least(F.coalesce("left_word_n", F.lit(0)), F.coalesce("right_word_n", F.lit(0)))
    verdict = F.when(F.col("mark") == "-", lower & ((j > k) | ((j == 0) & (k == 0)))).otherwise(lower & (j > PART_RATIO * rarer_part))
    judged = looked.select("a", "b", "mark", verdict.alias("broken")).where("broken")
    sure = every.where(soft | ((F.col("mark") == "-") & F.col("b").isNull())).select("candidate_no", "line_no")
    found_open = small_join(every.withColumn("mark", F.coalesce("mark", F.lit(""))), rt.written(judged.select("a", "b", "mark"), "ocr-broken"), ["a", "b", "mark"], "left_semi")
    return sure.unionByName(found_open.select("candidate_no", "line_no")).distinct()


@dataclass
class Repair:
    """Everything found on the pages."""

    pages: DataFrame
    model: Model
    events: DataFrame
    misread: DataFrame
    broken: DataFrame

    def furniture(self) -> DataFrame:
        """(candidate_no, line_no): furniture, with plain titles anywhere but on the first page of a scan."""
        first = self.pages.groupBy(F.col("source_path").alias("path")).agg(F.min("page").alias("first_page"))
        titles = self.events.where("kind = 'x'").select("candidate_no", "line_no", "path", "page").join(first, "path", "left")
        running = titles.where("first_page is null or page is null or page > first_page").select("candidate_no", "line_no")
        return self.events.where("kind = 'f'").select("candidate_no", "line_no").unionByName(running)

    def lines(self) -> DataFrame:
        """(candidate_no, line_no, kind)."""
        tokens = self.events.where("kind = 't'").select("candidate_no", "line_no", F.col("a").alias("word"))
        bad = small_join(tokens, self.misread.select("word"), ["word"], "left_semi").select("candidate_no", "line_no", F.lit("misread_word").alias("kind"))
        furniture = self.furniture().withColumn("kind", F.lit("furniture"))
        broken = self.broken.select("candidate_no", "line_no", F.lit("broken_word").alias("kind"))
        return furniture.unionByName(broken).unionByName(bad).distinct()


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = rt.table(
        spark, sf_dir, "ocr_candidates", F.col("candidate_no").cast("long").alias("candidate_no"), "originaltext", "page", "document_title", "pack_id",
        "source_path", "decision", "text",
    )
    packs = rt.table(spark, sf_dir, "catalog", F.col("id").alias("pack_id"), F.col("title").alias("pack_title"))
    return scans.join(packs, "pack_id", "left")


def repair(spark: SparkSession, sf_dir: str) -> Repair:
    rows = page_rows(spark, sf_dir)
    accepted = rows.where("decision = 'accept' and text is not null and originaltext is not null")
    share = min(1.0, FIT_PAGES / max(1, rt.table(spark, sf_dir, "ocr_candidates", "decision").where("decision = 'accept'").count()))
    sample = accepted.where(F.pmod(F.xxhash64("candidate_no"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * FIT_PAGES)
    sample = rt.written(sample.select("candidate_no", "originaltext", "text", "page", "document_title", "pack_title", "pack_id"), "ocr-sample")
    # whole pages up to FIT_CHARS characters in order of a hash; the rows are bounded
    so_far = F.sum(F.length("originaltext") + F.length("text")).over(Window.orderBy(F.xxhash64("candidate_no"), "candidate_no"))
    got = sample.withColumn("chars", so_far).where(F.col("chars") <= FIT_CHARS).drop("chars").collect()
    got = sorted(got, key=lambda r: r["candidate_no"])
    model = fit([(lines_of(r[1]), r[2], r[3], [r[4] or "", r[5] or ""], r[6]) for r in got])
    pages = rows.select("candidate_no", "originaltext", "page", "document_title", "pack_title", "pack_id", "source_path")
    ev = rt.written(events(pages, model), "ocr-events", ["kind"])
    vocab = rt.written(vocabulary(ev), "ocr-vocabulary")
    return Repair(pages, model, ev, rt.written(misread_words(ev, vocab, model), "ocr-misread"), broken_lines(ev, vocab))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture lines, broken words and misread words: (candidate_no, line_no, kind)."""
    return repair(spark, sf_dir).lines()


def rebuilt(text: str | None, furniture: set[int], breaks: set[int], broken: set[int], fixes: dict[str, str]) -> str:
    """Paragraphs of a page from its judged lines (numbered from 1)."""
    out: list[str] = []
    glue = False
    for i, line in enumerate(lines_of(text), 1):
        line = line.strip()
        if not line or i in furniture:
            continue
        fixed = WORD.sub(lambda m: fixes.get(m[0], m[0]), line)
        hyphen = bool(re.search(rf"[{MARKS}]$", fixed))
        if i in broken:
            fixed = re.sub(rf"[{MARKS}]$", "", fixed)
        if not out or (i in breaks and not glue):
            out.append(fixed)
        else:
            out[-1] += ("" if glue else " ") + fixed
        glue = i in broken or hyphen
    return "\n\n".join(out)


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_no, text): the page's own wording in continuous paragraphs."""
    r = repair(spark, sf_dir)
    of = lambda df, kind, name: df.groupBy("candidate_no").agg(F.collect_set("line_no").alias(name))  # noqa: E731, ARG005
    tokens = r.events.where("kind = 't'").select("candidate_no", F.col("a").alias("word"))
    fixes = small_join(tokens, r.misread.where("repaired is not null"), ["word"], "inner").groupBy("candidate_no").agg(F.collect_set(F.struct("word", "repaired")).alias("fixes"))
    # the collected sets are the lines and words of one page
    pages = (
        r.pages.select("candidate_no", "originaltext")
        .join(of(r.furniture(), "f", "furniture"), "candidate_no", "left")
        .join(of(r.events.where("kind in ('p', 'x')"), "p", "breaks"), "candidate_no", "left")
        .join(of(r.broken, "b", "broken"), "candidate_no", "left")
        .join(fixes, "candidate_no", "left")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if t is None else rebuilt(t, set(f or ()), set(p or ()), set(b or ()), {x["word"]: x["repaired"] for x in w or ()})
                for _, t, f, p, b, w in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["candidate_no", "text"])

    return pages.select("candidate_no", "originaltext", "furniture", "breaks", "broken", "fixes").mapInArrow(run, "candidate_no long, text string")
