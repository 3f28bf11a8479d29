"""Language and confidence of documents, of segments of mixed documents and of packs.

Nearest-centroid classification. Texts are cut into units (sentences, lines; long
ones at spaces); a unit is the normalised TF-IDF vector of its letter trigrams
(hashed, words bounded by spaces), compared by cosine with three clustered
centroids per language. Document frequencies come from all documents; centroids
from a bounded sample of labelled ones (FIT_DOCS documents, FIT_UNITS units per
language), from which units nearer to another language are removed again, as
labels are not always right. A unit's neighbours smooth its language; a text whose
letters stay below the similarity almost all fitted units of the language reach is
rejected as ``und``.

Defined cases: null, empty and letterless texts are ``und`` with confidence 0;
languages without fitted units cannot be assigned; with no labelled documents all
is ``und``; ties go to the first language in code order; repeated rows are treated
alike; whole texts are used.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import runtime as rt

DIM = 4096
CLUSTERS = 3
#: Bounds of the fitting sample.
FIT_DOCS, FIT_CHARS = 3000, 60_000_000
FIT_UNITS = 1200
#: A unit much longer than this is cut at a space.
UNIT = 240
#: Weight of a full unit's similarity against the cost of a change of language between neighbours.
SHARP, SWITCH, FULL_LETTERS = 40.0, 4.0, 80
#: A second language with this share of the letters makes a document mixed.
MIXED = 0.2
#: Share of fitted units that lie below the rejection similarity of their language.
REJECT_SHARE = 0.005
CHUNK = 400_000
UND = "und"

# Two-letter language codes.
CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj "
    "fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la "
    "lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa "
    "sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
)
# Three-letter codes and names (English, own) of languages.
NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano castilian",
    "ru": "rus russian русский", "uk": "ukr ukrainian українська", "it": "ita italian italiano", "pt": "por portuguese português portugues",
    "nl": "nld dut dutch nederlands", "pl": "pol polish polski", "cs": "ces cze czech čeština", "sk": "slk slo slovak slovenčina", "be": "bel belarusian беларуская",
    "bg": "bul bulgarian български", "sr": "srp serbian српски", "hr": "hrv croatian hrvatski", "ro": "ron rum romanian română", "hu": "hun hungarian magyar",
    "sv": "swe swedish svenska", "da": "dan danish dansk", "no": "nor norwegian norsk", "fi": "fin finnish suomi", "el": "ell gre greek ελληνικά",
    "tr": "tur turkish türkçe", "ar": "ara arabic العربية", "he": "heb hebrew עברית", "fa": "fas per persian فارسی", "hi": "hin hindi हिन्दी",
    "zh": "zho chi chinese 中文", "ja": "jpn japanese 日本語", "ko": "kor korean 한국어", "vi": "vie vietnamese", "th": "tha thai ไทย", "id": "ind indonesian",
    "af": "afr afrikaans", "sq": "sqi alb albanian shqip", "am": "amh amharic", "hy": "hye arm armenian", "az": "aze azerbaijani", "eu": "eus baq basque euskara",
    "bn": "ben bengali", "bs": "bos bosnian bosanski", "my": "mya bur burmese", "cy": "cym wel welsh cymraeg", "eo": "epo esperanto", "ga": "gle irish gaeilge",
    "gl": "glg galician galego", "gu": "guj gujarati", "ha": "hau hausa", "ig": "ibo igbo", "is": "isl ice icelandic íslenska", "jv": "jav javanese", "ka": "kat geo georgian",
    "km": "khm khmer", "kn": "kan kannada", "ku": "kur kurdish", "ky": "kir kyrgyz", "lb": "ltz luxembourgish", "lo": "lao", "mg": "mlg malagasy", "mi": "mri mao maori",
    "mk": "mkd mac macedonian македонски", "ml": "mal malayalam", "mn": "mon mongolian", "mr": "mar marathi", "ms": "msa may malay", "mt": "mlt maltese malti",
    "ne": "nep nepali", "nb": "nob", "nn": "nno", "pa": "pan punjabi", "ps": "pus pashto", "rm": "roh romansh", "sa": "san sanskrit", "si": "sin sinhala",
    "sl": "slv slovene slovenian slovenščina", "so": "som somali", "sw": "swa swahili kiswahili", "ta": "tam tamil", "te": "tel telugu", "tg": "tgk tajik",
    "tk": "tuk turkmen", "tl": "tgl tagalog", "tt": "tat tatar татарча", "ug": "uig uyghur", "ur": "urd urdu", "uz": "uzb uzbek", "xh": "xho xhosa", "yi": "yid yiddish",
    "yo": "yor yoruba", "zu": "zul zulu",
    "ca": "cat catalan català", "et": "est estonian eesti", "lv": "lav latvian latviešu", "lt": "lit lithuanian lietuvių", "la": "lat latin latina", "kk": "kaz kazakh қазақша",
}
LANGUAGE_OF = {c: c for c in CODES.split()} | {n: code for code, names in NAMES.items() for n in names.split()}


def named_language(label: str | None) -> str | None:
    """Code of the language a label names (code with or without region, or name); None if it names none."""
    if label is None:
        return None
    plain = unicodedata.normalize("NFC", label).strip().lower()
    if plain in LANGUAGE_OF:
        return LANGUAGE_OF[plain]
    m = re.fullmatch(r"([a-z]{2,3})(?:[-_][a-z]{4})?(?:[-_](?:[a-z]{2}|\d{3}))?(?:\.[\w-]+)?", plain)
    return LANGUAGE_OF.get(m[1]) if m else None


@lru_cache(maxsize=1)
def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """For every code point of the basic plane: its lower-case letter or a space, and whether it is a letter."""
    low = np.full(65536, 32, np.uint32)
    letter = np.zeros(65536, bool)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            small = ch.lower()
            low[c] = ord(small) if len(small) == 1 else c
            letter[c] = True
        elif unicodedata.category(ch) == "Mn":
            low[c] = 0  # dropped
    return low, letter


@dataclass
class Units:
    """Units of a list of texts: which text, from and to which character, how many letters; trigram buckets by unit."""

    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    letters: np.ndarray
    unit_of: np.ndarray
    bucket: np.ndarray


def units_of(texts: list[str]) -> Units:
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    low, letter = letter_table()
    small = np.where(cp < 65536, cp, 32)
    y, is_letter = low[small], letter[small]
    space = (cp == 32) | (cp == 10) | (cp == 13) | (cp == 9) | (cp == 160)
    stop_mark = (cp == 46) | (cp == 33) | (cp == 63) | (cp == 0x2026) | (cp == 0x3002)
    cut = cp == 10
    cut[1:] |= space[1:] & stop_mark[:-1]
    at = np.flatnonzero(cut)  # a unit ends with its cut character
    starts = np.concatenate([[0], at[:-1] + 1])
    long = np.flatnonzero(at + 1 - starts > 1.5 * UNIT)
    if len(long):
        spaces = np.flatnonzero(space)
        more = [np.arange(starts[u] + UNIT, at[u] - UNIT // 2, UNIT) for u in long]
        wanted = np.concatenate(more) if more else np.empty(0, np.int64)
        limit = np.repeat(at[long], [len(m) for m in more])
        near = spaces[np.minimum(np.searchsorted(spaces, wanted), len(spaces) - 1)]
        at = np.union1d(at, near[(near >= wanted) & (near < limit)])
        starts = np.concatenate([[0], at[:-1] + 1])
    doc = np.searchsorted(ends, starts, side="right")
    offset = (ends - sizes)[doc]
    counts = np.add.reduceat(is_letter.astype(np.int64), starts)
    keep = (y != 0) & ~((y == 32) & np.concatenate([[False], y[:-1] == 32]))
    pos = np.flatnonzero(keep)
    z = y[pos].astype(np.uint32)
    if len(z) < 3:
        empty = np.empty(0, np.int64)
        return Units(doc, starts - offset, at + 1 - offset, counts, empty, empty)
    h = z[:-2] * np.uint32(0x9E3779B1) + z[1:-1] * np.uint32(0x85EBCA77) + z[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(20)).astype(np.int64)  # DIM = 4096
    middle = z[1:-1] != 32  # a trigram belongs to the unit of its middle letter
    unit_of = np.searchsorted(at, pos[1:-1][middle])
    return Units(doc, starts - offset, at + 1 - offset, counts, unit_of, bucket[middle])


def chunks(values: list, sizes: list[int], limit: int = CHUNK) -> Iterator[slice]:
    """Slices of the list with about `limit` characters each."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total > limit:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(values):
        yield slice(start, len(values))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Share of all documents in which each trigram bucket occurs; DIM numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            rows = [t or "" for t in batch.column(0).to_pylist()]
            for part in chunks(rows, list(map(len, rows))):
                u = units_of(rows[part])
                owner = u.doc[u.unit_of] if len(u.unit_of) else u.unit_of
                bounds = np.searchsorted(owner, np.arange(len(rows[part]) + 1))
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    df += np.bincount(u.bucket[a:b], minlength=DIM) > 0
            n += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(df, n))], names=["bucket", "docs"])

    counted = texts.mapInArrow(run, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect()
    out = np.zeros(DIM + 1)
    for r in counted:
        out[r["bucket"]] = r["docs"]
    return out[:DIM] / max(1.0, out[DIM])


@dataclass
class Model:
    """idf by bucket, unit centroids (row per cluster, weighted by idf already in `table`), languages and rejection similarity."""

    languages: list[str]
    idf: np.ndarray
    table: np.ndarray  # (DIM, clusters): idf times centroid
    owner: np.ndarray  # language of each cluster
    floor: np.ndarray  # rejection similarity of each language

    def similarities(self, u: Units) -> np.ndarray:
        """(units, languages) cosines with the nearest centroid of each language."""
        n, k = len(u.doc), len(self.owner)
        out = np.zeros((n, len(self.languages)))
        if not len(u.unit_of) or not k:
            return out
        filled, first = np.unique(u.unit_of, return_index=True)
        dots = np.add.reduceat(self.table[u.bucket], first, axis=0)
        slots = 1 << max(16, int(np.ceil(np.log2(4 * len(u.bucket)))))
        pair = u.unit_of.astype(np.uint64) * np.uint64(DIM) + u.bucket.astype(np.uint64)
        slot = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) & (slots - 1)
        often = np.bincount(slot, minlength=slots)[slot]  # occurrences of the bucket in the unit
        norm = np.sqrt(np.add.reduceat(self.idf[u.bucket] ** 2 * often, first))
        cos = dots / np.maximum(norm, 1e-9)[:, None]
        for i in range(len(self.languages)):
            out[filled, i] = cos[:, self.owner == i].max(axis=1)
        return out


def dense(u: Units, rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors of some units."""
    where = np.full(len(u.doc), -1)
    where[rows] = np.arange(len(rows))
    at = where[u.unit_of]
    ok = at >= 0
    x = np.bincount(at[ok] * DIM + u.bucket[ok], minlength=len(rows) * DIM).reshape(len(rows), DIM) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with a deterministic start."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(8):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(labelled: list[tuple[str, str]], frequencies: np.ndarray) -> Model:
    """Model from (text, language) of labelled documents."""
    idf = np.log((1 + 1) / (frequencies + 1e-4)).clip(0.05)
    vectors: dict[str, np.ndarray] = {}
    for language in sorted({code for _, code in labelled}):
        texts = [t for t, code in labelled if code == language]
        parts = []
        for part in chunks(texts, list(map(len, texts))):
            u = units_of(texts[part])
            good = np.flatnonzero(u.letters >= 30)
            share = max(1, FIT_UNITS * len(texts[part]) // max(1, len(texts)))
            good = good[np.linspace(0, len(good) - 1, min(share, len(good))).astype(int)] if len(good) else good
            parts.append(dense(u, good, idf))
        x = np.concatenate(parts) if parts else np.empty((0, DIM), np.float32)
        if len(x) >= 5:
            vectors[language] = x[:FIT_UNITS]
    languages = list(vectors)
    own = {code: np.ones(len(x), bool) for code, x in vectors.items()}
    for _ in range(4):  # drop units that lie nearer to another language's mean: wrong labels, mixed texts
        means = np.stack([v[own[c]].mean(axis=0) / max(1e-9, float(np.linalg.norm(v[own[c]].mean(axis=0)))) for c, v in vectors.items()]) if languages else np.empty((0, DIM))
        for i, code in enumerate(languages):
            ok = (vectors[code] @ means.T).argmax(axis=1) == i
            if ok.sum() >= 5:
                own[code] = ok
    rows, owner, floor = [], [], []
    for i, code in enumerate(languages):
        x = vectors[code][own[code]]
        c = _centroids(x, CLUSTERS)
        rows.append(c)
        owner += [i] * len(c)
        floor.append(float(np.quantile((x @ c.T).max(axis=1), REJECT_SHARE)) * 0.7)
    centroids = np.concatenate(rows) if rows else np.empty((0, DIM), np.float32)
    return Model(languages, idf.astype(np.float64), (centroids * idf).T.astype(np.float32).copy(), np.array(owner, int), np.array(floor))


def _smoothed(score: np.ndarray) -> np.ndarray:
    """Best sequence of languages for the units of one text: each unit's score, less SWITCH for every change."""
    n, k = score.shape
    best, back = score[0].copy(), np.zeros((n, k), np.int64)
    for t in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back[t] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - SWITCH) + score[t]
    path = np.empty(n, np.int64)
    path[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def classify(texts: list[str], model: Model) -> list[dict]:
    """language, confidence, second language and its share, and segments of every text."""
    u = units_of(texts)
    sims = model.similarities(u)
    k = len(model.languages)
    score = sims * (np.minimum(u.letters, FULL_LETTERS) / FULL_LETTERS * SHARP)[:, None]
    bounds = np.searchsorted(u.doc, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        letters, s = u.letters[a:b], sims[a:b]
        total = int(letters.sum())
        if not total or not k:
            out.append({"language": UND, "confidence": 0.0, "second": None, "second_share": 0.0, "segments": []})
            continue
        votes = s.argmax(axis=1)
        clear = votes[letters >= 12]
        path = np.full(b - a, clear[0]) if len(clear) and (clear == clear[0]).all() else _smoothed(score[a:b])
        share = np.bincount(path, weights=letters, minlength=k) / total
        order = np.argsort(-share, kind="stable")
        main = int(order[0])
        mean = (s * letters[:, None])[path == main].sum(axis=0) / max(1, letters[path == main].sum())
        near = 1 / (1 + np.exp(-20 * (mean[main] - np.delete(mean, main)))).prod() if k > 1 else 1.0
        certain = float(share[main] * near)
        segments = []
        edges = np.flatnonzero(np.diff(path)) + 1
        for lo, hi in zip([0, *edges], [*edges, b - a], strict=True):
            w = letters[lo:hi]
            m = (s[lo:hi] * w[:, None]).sum(axis=0) / max(1, w.sum())
            margin = m[path[lo]] - np.delete(m, path[lo]).max() if k > 1 else m[path[lo]]
            segments.append({
                "start": int(u.start[a + lo]), "stop": int(min(u.stop[a + hi - 1], len(texts[i]))), "language": model.languages[path[lo]],
                "letters": int(w.sum()), "confidence": round(float(1 / (1 + np.exp(-20 * margin))), 6),
            })
        rejected = mean[main] < model.floor[main]
        second = int(order[1]) if k > 1 else main
        out.append({
            "language": UND if rejected else model.languages[main], "confidence": 0.0 if rejected else round(min(1.0, certain), 6),
            "second": model.languages[second] if k > 1 and share[second] > 0 else None,
            "second_share": float(share[second]) if k > 1 else 0.0, "segments": segments,
        })
    return out


RESULT = (
    "key string, label string, labelled string, language string, confidence double, second string, second_share double, "
    "segments array<struct<start:int, stop:int, language:string, letters:int, confidence:double>>"
)
_segments = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("language", pa.string()), ("letters", pa.int32()), ("confidence", pa.float64())]))


def identified(rows: DataFrame, model: Model) -> DataFrame:
    """Results for rows of (key, label, text)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # DIM x clusters numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for part in chunks(texts, list(map(len, texts))):
                got = classify(texts[part], sent.value)
                col = lambda f, t, got=got: pa.array([g[f] for g in got], t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[part], pa.string()), pa.array(labels[part], pa.string()), pa.array([named_language(x) for x in labels[part]], pa.string()),
                        col("language", pa.string()), col("confidence", pa.float64()), col("second", pa.string()), col("second_share", pa.float64()), col("segments", _segments),
                    ],
                    names=["key", "label", "labelled", "language", "confidence", "second", "second_share", "segments"],
                )

    return rows.select("key", "label", "text").mapInArrow(run, RESULT)


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    docs = rt.table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    frequencies = document_frequencies(docs.select("text"))
    labelled = docs.where(F.coalesce(F.length(F.trim("lang")), F.lit(0)) >= 2)
    share = min(1.0, FIT_DOCS / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * FIT_DOCS)
    sample = rt.written(sample, "language-sample")
    # whole texts up to FIT_CHARS characters in order of a hash; the rows are bounded
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    got = sample.withColumn("chars", so_far).where(F.col("chars") <= FIT_CHARS).drop("chars").collect()
    pairs = [(r["text"] or "", named_language(r["lang"])) for r in sorted(got, key=lambda r: r["doc_id"])]
    return fit([(t, code) for t, code in pairs if code], frequencies)


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rt.table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return docs.select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("label"), "text")


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = rt.table(spark, sf_dir, "catalog", "id", "language", "title", "description")
    return packs.select(F.col("id").alias("key"), F.col("language").alias("label"), F.concat_ws("\n", "title", "description").alias("text"))


def problems(results: DataFrame, table_name: str, mixed: bool) -> DataFrame:
    bad = [
        F.when(F.col("labelled").isNull(), "missing"),
        F.when(F.col("labelled").isNotNull() & (F.col("language") != UND) & (F.col("labelled") != F.col("language")), "wrong"),
    ]
    if mixed:
        bad.append(F.when(F.col("second_share") >= MIXED, "mixed"))
    return results.select(
        F.lit(table_name).alias("table_name"), F.col("key").alias("row_key"), F.explode(F.filter(F.array(*bad), lambda p: p.isNotNull())).alias("problem")
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, wrong and mixed language labels: (table_name, row_key, problem)."""
    model = fitted(spark, sf_dir)
    docs = problems(identified(document_rows(spark, sf_dir), model), "documents", True)
    return docs.unionByName(problems(identified(catalog_rows(spark, sf_dir), model), "catalog", False))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and pack."""
    model = fitted(spark, sf_dir)
    both = identified(document_rows(spark, sf_dir), model).withColumn("table_name", F.lit("documents")).unionByName(
        identified(catalog_rows(spark, sf_dir), model).withColumn("table_name", F.lit("catalog"))
    )
    return both.select("table_name", F.col("key").alias("row_key"), "label", "language", "confidence", "second", F.round("second_share", 6).alias("second_share"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the mixed documents with language and confidence."""
    rows = identified(document_rows(spark, sf_dir), fitted(spark, sf_dir)).where(F.col("second_share") > 0)
    return rows.select(F.col("key").cast("long").alias("doc_id"), F.posexplode("segments").alias("at", "s")).select(
        "doc_id", (F.col("at") + 1).alias("segment_no"), "s.start", "s.stop", "s.language", "s.letters", "s.confidence"
    )
