"""Toxicity by noisy-channel deobfuscation.

Spans that look disguised (letters mixed with digits or signs, three or more letters spelled out with white space or signs
between, letters three times over), and those that give a weighty word with doubled letters taken once or with two or three fragments
together, become lattices of the characters they may stand for; a Viterbi decoding under a character trigram model gives the
restored word, which is scored with the words that stand plainly in the text.

Words and word beginnings are weighed by their log odds in toxic texts against others; a logistic regression on a text's
highest weights gives the score.  All is fitted on every labelled row that is not held out; texts that are near copies of each
other count once, by a minimum hash of their 3-word shingles, and the regression, whose sums are made in the tasks, sees weights from the
other half of the rows.

Null and empty texts get the score of a text without any weighty word.  With no labelled rows of both kinds, every score is 0.
A document with several labels counts as toxic if one is.  Rows: one for each input row, repeated ones and null ids included.
"""

from __future__ import annotations

import math
import pickle
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from functools import cache
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import Handle

FOLDS, TOP, CACHE = 2, 3, 50_000
#: Bits of a piece of a bitmap (the most that Spark's aggregate makes), and of the labels' bitmap: for a label, and at most.
PIECE, EACH, MOST = 1 << 15, 16, 1 << 27
#: A longer span is decoded in windows of this many characters that overlap by a quarter, whole.
WINDOW = 256
#: Letters of the words looked for in what several spelled-out words give together.
WITHIN = range(4, 17)
PREFIXES = (4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+")
#: What a character may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " ._-*~'/,\"\n\t\r"
SIGNS = re.escape("".join(k for k in LEET if not k.isdigit()))
#: A letter with a digit or sign on either side or a letter three times over, within a token.
MIXED = re.compile(rf"(?=\S*[^\W\d_])(?:\S*[^\W\d_][\d{SIGNS}*._-]+[^\W\d_]\S*|[\d{SIGNS}]+[^\W\d_]\S*|\S*[^\W\d_][\d$@!|]+)")
REPEATED, DOUBLED = re.compile(r"([^\W\d_])\1\1"), re.compile(r"([^\W\d_])\1+")
#: Three or more single characters with white space or signs between; what may stand between is none of the characters.
SPELLED = re.compile(rf"(?<!\w)(?:(?:[^\W_]|[{SIGNS}])[\s.,_*~/'\"-]{{1,5}}){{2,}}(?:[^\W_]|[{SIGNS}])(?!\w)")
#: Bits of a character's kind, and the characters of each: the classes of the patterns above.
LETTER, ALNUM, BEFORE, AFTER, SPACE, ALONE, BETWEEN = (1 << i for i in range(7))
CLASSES = {LETTER: r"[^\W\d_]", ALNUM: r"[^\W_]", BEFORE: rf"[\d{SIGNS}*._-]", AFTER: r"[\d$@!|]", SPACE: r"\s", ALONE: rf"(?:[^\W_]|[{SIGNS}])", BETWEEN: r"[\s.,_*~/'\"-]"}


class CharModel:
    """A trigram model of letters over words, with interpolation; '^' stands before a word and '$' after it."""

    def __init__(self, counts: dict[str, int]):
        self.tri, self.bi, self.uni, self.ctx2, self.ctx1 = Counter(), Counter(), Counter(), Counter(), Counter()
        for g, n in counts.items():
            self.tri[g] += n
            self.ctx2[g[:2]] += n
            self.bi[g[1:]] += n
            self.ctx1[g[1]] += n
            self.uni[g[2]] += n
        self.total = sum(self.uni.values())
        self.memo: dict[str, float] = {}

    def log_p(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        got = self.memo.get(key)
        if got is None:
            p = 0.05 / 100 + 0.1 * (self.uni[c] + 0.5) / (self.total + 50)
            p += 0.25 * self.bi[b + c] / max(1, self.ctx1[b]) + 0.6 * self.tri[key] / max(1, self.ctx2[a + b])
            got = self.memo[key] = math.log(p)
        return got


def char_grams(word: str) -> list[str]:
    padded = f"^^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def decode(span: str, chars: CharModel, drop_repeats: bool = True) -> str:
    """The likeliest word behind a disguised span: Viterbi over (previous two letters), characters kept, replaced or dropped."""
    span = span.lower()
    best: dict[tuple[str, str], tuple[float, str]] = {("^", "^"): (0.0, "")}
    last = ""
    for o in span:
        options: list[tuple[str, float]] = []
        if o.isalpha():
            options.append((o, -0.05))
            if o == last and drop_repeats:
                options.append(("", -0.9))
            plain = unicodedata.normalize("NFD", o)[0]
            if plain != o and plain.isalpha():
                options.append((plain, -2.5))
        elif o in LEET:
            options += [(c, -0.7 if len(LEET[o]) == 1 else -1.2) for c in LEET[o]]
            options.append(("", -0.9 if drop_repeats and last and (LEET.get(last) == LEET[o] or last in LEET[o]) else -9.0))
        else:
            options.append(("", -0.1 if o in SEPARATORS else -3.0))
        last = o if o not in SEPARATORS else last
        now: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (p, out) in best.items():
            for c, q in options:
                state, score, text = ((a, b), p + q, out) if not c else ((b, c), p + q + chars.log_p(a, b, c), out + c)
                if state not in now or (score, text) > now[state]:
                    now[state] = (score, text)
        best = now
    return max((p + chars.log_p(a, b, "$"), out) for (a, b), (p, out) in best.items())[1]


def windows(span: str) -> list[str]:
    """The span itself, or overlapping windows that cover all of it."""
    step = WINDOW - WINDOW // 4
    return [span] if len(span) <= WINDOW else [span[i : i + WINDOW] for i in range(0, len(span) - WINDOW // 4, step)]


@cache
def kinds() -> np.ndarray:
    """Every character's kind."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    table = np.zeros(len(every), np.uint8)
    for kind, characters in CLASSES.items():
        for m in re.finditer(f"{characters}+", every):
            table[m.start() : m.end()] |= kind
    return table


class Reading:
    """A lower-case text, between spaces, as arrays of its characters and of their kinds: words and candidates for the patterns are found without trying these everywhere."""

    def __init__(self, text: str):
        self.text, self.narrow = f" {text}  ", text.isascii()
        self.chars = np.frombuffer(self.text.encode(), np.uint8) if self.narrow else np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.kinds = kinds()[self.chars]
        self.letter = self.kinds & LETTER != 0
        self.same = self.letter[1:] & (self.chars[1:] == self.chars[:-1])
        self.spaced = np.where(self.letter, self.chars, self.chars.dtype.type(32))

    def split(self, spaced: np.ndarray) -> list[str]:
        data = spaced.tobytes()
        return (data.decode() if self.narrow else data.decode("utf-32-le", "surrogatepass")).split()

    def words(self) -> list[str]:
        """What WORDS finds."""
        return self.split(self.spaced)

    def single(self) -> list[str]:
        """The words with doubled letters taken once."""
        return self.split(self.spaced[1:][~self.same])

    def spelled(self) -> bool:
        """Whether SPELLED may match: its second and third character stand alone with at most five others between."""
        k = self.kinds
        between = k & BETWEEN != 0
        alone = np.flatnonzero((k[1:-1] & ALONE != 0) & between[:-2] & (k[2:] & ALNUM == 0)) + 1
        return bool((between[alone[:-1] + 1] & (np.diff(alone) <= 6)).any())

    def tokens(self) -> set[str]:
        """Tokens that MIXED or REPEATED may match: all that have a letter beside a digit or sign, or three times over."""
        here, after = self.kinds[:-1], self.kinds[1:]
        at = (here & BEFORE != 0) & self.letter[1:] | self.letter[:-1] & (after & AFTER != 0)
        at[:-1] |= self.same[:-1] & self.same[1:]
        places = np.flatnonzero(at)
        if not len(places):
            return set()
        edges = np.flatnonzero(self.kinds & SPACE)
        ends = np.array(sorted(set(np.searchsorted(edges, places).tolist())))
        return {self.text[i + 1 : j] for i, j in zip(edges[ends - 1].tolist(), edges[ends].tolist(), strict=True)}


def disguised(reading: Reading) -> set[str]:
    """Distinct spans of a lower-case text that may hide a word."""
    spans = {m[0] for m in SPELLED.finditer(reading.text)} if reading.spelled() else set()
    for token in reading.tokens():
        if not token.isalpha() and MIXED.match(token) or REPEATED.search(token):
            spans.add(token.strip(".,;:?\"()"))
    return spans


def stripped(word: str) -> str:
    return "".join(unicodedata.normalize("NFD", c)[0] for c in word)


def lead(span: str) -> str:
    """Up to four first letters that any decoding keeps, without accents: up to a sign or a letter that may be a repetition."""
    out = ""
    for c in span:
        base = unicodedata.normalize("NFD", c)[0]
        if not c.isalpha() or out[-1:] == base or len(out) == 4:
            break
        out += base
    return out


def keys_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def minimum_hash(text: str) -> int:
    """Near copies mostly agree in it."""
    import xxhash

    words = text.lower().split()
    threes = map(" ".join, zip(words, islice(words, 1, None), islice(words, 2, None), strict=False)) if len(words) > 2 else [" ".join(words)]
    return min(map(xxhash.xxh64_intdigest, threes)) >> 1


def _marking(batches):
    for batch in batches:
        marks = [minimum_hash(x or "") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], ["doc_id", "text", "mark"])


def has_bit(bits: str, place: str) -> str:
    """Whether a place's piece of a bitmap has its bit, in SQL."""
    return f"getbit(int(conv(hex(substring({bits}, int({place} % {PIECE} div 8) + 1, 1)), 16, 10)), int({place} % 8)) = 1"


def likely(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows (doc_id, text) that have a label, and a few others: a broadcast bitmap of the labels' hashed ids drops most rows without one, whose texts no join has to shuffle."""
    if not {dict(x.dtypes)["doc_id"] for x in (rows, marked)} <= {"tinyint", "smallint", "int", "bigint"}:
        return rows  # ids that are equal may have other hashes
    size = min(MOST, PIECE * (1 + marked.count() * EACH // PIECE))
    place = F.expr(f"pmod(xxhash64(bigint(doc_id)), {size}L)").alias("place")
    bits = marked.select(place).groupBy(F.expr(f"place div {PIECE}").alias("piece")).agg(F.expr(f"bitmap_construct_agg(place % {PIECE})").alias("bits"))
    placed = rows.select("*", place).withColumn("piece", F.expr(f"place div {PIECE}"))
    return placed.join(F.broadcast(bits), "piece").where(has_bit("bits", "place")).select(rows.columns)


def distinct_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text, mark) of the labelled rows, one for each mark and kind, from a stored table.  Only ids and hashes are shuffled, no text: what is kept of the stored rows goes back to them as bitmaps."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = likely(docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null"), marked)
    rows = rows.mapInArrow(_marking, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, mark long")
    stored = common.materialise(rows.withColumn("row", F.monotonically_increasing_id()), "toxicity-texts")
    first = stored.select("doc_id", "mark", "row", F.xxhash64("text").alias("hash")).join(marked, "doc_id").groupBy("mark", "toxic").agg(F.min(F.struct("hash", "row")).alias("first"))
    bits = [F.expr(f"bitmap_construct_agg(if(toxic = {y}, first.row % {PIECE}, null))").alias(f"bits{y}") for y in (0, 1)]
    kept = common.materialise(first.groupBy(F.expr(f"first.row div {PIECE}").alias("piece")).agg(*bits), "toxicity-rows")
    both = stored.withColumn("piece", F.expr(f"row div {PIECE}")).join(F.broadcast(kept), "piece").select(*(F.expr(has_bit(f"bits{y}", "row")).alias(f"is{y}") for y in (0, 1)), "text", "mark")
    return both.where("is0 or is1").select(F.col("is1").cast("int").alias("toxic"), "text", "mark")


def _counting(batches):
    """Rows (kind, key, fold, toxic, n): texts that hold a key, and letter trigrams."""
    held: defaultdict[tuple[int, int, str], Counter] = defaultdict(Counter)  # by fold, kind of text, and what its keys end in
    texts: Counter = Counter()
    whole: Counter = Counter()

    def out():
        grams: Counter = Counter()
        for w, n in whole.items():
            for g in char_grams(w):
                grams[g] += n
        tables = [*(("w", *k, c) for k, c in held.items()), ("c", 0, 0, "", grams), *(("n", *k, "", {"": n}) for k, n in texts.items())]
        for kind, fold, toxic, end, table in tables:
            size = len(table)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * size), pa.array([key + end for key in table] if end else list(table)), pa.array([fold] * size, pa.int32()), pa.array([toxic] * size, pa.int32()), pa.array(list(table.values()), pa.int64())], ["kind", "key", "fold", "toxic", "n"])
        for table in (held, texts, whole):
            table.clear()

    for batch in batches:
        for toxic, text, mark in zip(*batch.to_pydict().values(), strict=True):
            words = set(Reading((text or "").lower()).words())
            fold = mark % FOLDS
            held[fold, toxic, ""].update(words)
            longer = words
            for n in PREFIXES:
                longer = [w for w in longer if len(w) > n]
                held[fold, toxic, "*"].update({w[:n] for w in longer})
            whole.update(words)
            texts[fold, toxic] += 1
        if sum(map(len, held.values())) > 300_000:
            yield from out()
    if texts:
        yield from out()


class Model:
    def __init__(self, weights: dict[str, float], chars: CharModel, coefficients):
        self.weights, self.chars, self.coefficients = weights, chars, coefficients
        self.cache: dict[str, float] = {}
        self.restored: dict[str, tuple[str, ...]] = {}
        #: Weighty words, and what is left of them with doubled letters taken once.
        self.whole = {w for w in weights if not w.endswith("*")}
        self.single = {DOUBLED.sub(r"\1", w) for w in self.whole}
        #: What they begin with, less than whole.
        self.heads = {w[:n] for w in self.whole for n in range(1, len(w))}
        #: How words with a weight may begin.
        self.begins = {w.rstrip("*")[:4] for w in weights}
        self.starts = {stripped(w.rstrip("*"))[:n] for w in weights for n in range(5)}

    def weight(self, word: str) -> float:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            get = self.weights.get
            got = self.cache[word] = max(get(k, 0.0) for k in keys_of(word))
        return got

    def restore(self, span: str) -> tuple[str, ...]:
        """The likeliest words, repeated letters dropped or all kept; of letters spelled out, which may be several words, the weighty ones within too."""
        got = self.restored.get(span)
        if got is None:
            if len(self.restored) > CACHE:
                self.restored.clear()
            words: dict[str, None] = {}
            for part in windows(span):
                for whole in (decode(part, self.chars), decode(part, self.chars, False)):
                    words[whole] = None
                    if SPELLED.search(part):
                        words.update((w, None) for n in WITHIN for i in range(len(whole) - n + 1) if (w := whole[i : i + n]) in self.weights)
            got = self.restored[span] = tuple(words)
        return got

    def hidden(self, found: list[str], single: list[str]) -> set[str]:
        """Spans whose words may be weighty with doubled letters taken once, or two or three fragments taken together."""
        spans: set[str] = set()
        if not self.single.isdisjoint(single):
            spans.update(w for w, s in zip(found, single, strict=True) if s in self.single and w not in self.whole)
        for i in compress(range(len(found) - 1), map(self.heads.__contains__, found)):
            joined = found[i]
            for n in range(i + 1, min(i + 3, len(found))):
                joined += found[n]
                if joined in self.whole:
                    spans.add(" ".join(found[i : n + 1]))
                if joined not in self.heads:
                    break
        return spans

    def top(self, text: str | None) -> list[float]:
        """The TOP highest weights of the text's words, plain and restored."""
        if not text:
            return [0.0] * TOP
        reading = Reading(text.lower())
        found = reading.words()
        words = set(found)
        spans = {s for s in disguised(reading) if SPELLED.match(s) or lead(s) in self.starts}  # others can't hide a word with a weight
        words.update(w for s in spans | self.hidden(found, reading.single()) for w in self.restore(s))
        weight = self.weight
        begins = self.begins
        best = sorted((x for w in words if w[:4] in begins and (x := weight(w)) > 0), reverse=True)[:TOP]
        return best + [0.0] * (TOP - len(best))

    def score(self, text: str | None) -> float:
        if self.coefficients is None:
            return 0.0
        z = float(np.dot(self.coefficients[1:], self.top(text)) + self.coefficients[0])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def may_weigh(totals, folds, tried: int) -> str:
    """The condition of ``log_odds`` in SQL, on the columns n<fold><toxic>, with room for rounding."""
    n1, n0 = (max(1, sum(totals[f, y] for f in folds)) for y in (1, 0))
    share = n1 / (n1 + n0)
    k1, k0 = (f"double({' + '.join(f'n{f}{y}' for f in folds)})" for y in (1, 0))
    gain = f"{k1} * ln({k1} / (({k1} + {k0}) * {share!r}D)) + if({k0} > 0, {k0} * ln({k0} / (({k1} + {k0}) * {1 - share!r}D)), 0D)"
    return f"{k1} > 0 and {k1} > ({k1} + {k0}) * {share!r}D - 1e-6D and {gain} > {math.log(max(tried, 1)) + 1 - 1e-6!r}D"


def log_odds(counts, totals, folds, tried: int) -> dict[str, float]:
    """Weights of the keys that toxic texts of these folds have far oftener than others.

    A key counts if its likelihood ratio against chance is above what the best of ``tried`` keys may have by chance.
    """
    out = {}
    n1, n0 = (max(1, sum(totals[f, y] for f in folds)) for y in (1, 0))
    share = n1 / (n1 + n0)
    for key, c in counts.items():
        k1, k0 = (sum(c.get((f, y), 0) for f in folds) for y in (1, 0))
        if k1 > (k1 + k0) * share:
            k = k1 + k0
            gain = k1 * math.log(k1 / (k * share)) + (k0 * math.log(k0 / (k * (1 - share))) if k0 else 0)
            if gain > math.log(max(tried, 1)) + 1:
                out[key] = math.log((k1 + 0.1) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))
    return out


def _steps(w: np.ndarray):
    """A row for a task: the sums of the gradient and of the Hessian at these coefficients."""

    def run(batches):
        g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in batches:
            y, *x = (c.to_numpy() for c in batch.columns)
            x = np.c_[np.ones(len(y)), np.array(x).T]
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g += x.T @ (y - p)
            h += (x * (p * (1 - p))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([g.tolist()], pa.list_(pa.float64())), pa.array([h.ravel().tolist()], pa.list_(pa.float64()))], ["g", "h"])

    return run


def regression(rows: DataFrame) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method, of the rows' first column on the others; coefficients of the weights aren't negative."""
    w = np.zeros(len(rows.columns))
    for _ in range(30):
        sums = rows.mapInArrow(_steps(w), "g array<double>, h array<double>").collect()
        g = np.sum([r.g for r in sums], axis=0) - 0.1 * w
        h = np.sum([r.h for r in sums], axis=0).reshape(len(w), -1) + 0.1 * np.eye(len(w))
        last, w = w, w + np.linalg.solve(h, g)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(w - last).max() < 1e-9:
            break
    return w


def _tops(handle):
    def run(batches):
        models = common.worker_held(("toxicity-apart", handle.id), lambda: pickle.loads(handle.value))
        for batch in batches:
            rows = [[y, *models[mark % FOLDS].top(text)] for y, text, mark in zip(*batch.to_pydict().values(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(v) for v in c]) for c in zip(*rows, strict=True)], ["y", "a", "b", "c"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: training rows; labels: (doc_id, toxic)."""
    spark = docs.sparkSession
    common.prepare(spark)
    once = distinct_rows(docs, labels)
    found = once.mapInArrow(_counting, "kind string, key string, fold int, toxic int, n long").groupBy("kind", "key", "fold", "toxic").agg(F.sum("n").alias("n"))
    found = common.materialise(found, "toxicity-counts")
    totals: Counter = Counter({(r[0], r[1]): r[2] for r in found.where("kind = 'n'").select("fold", "toxic", "n").collect()})
    chars = CharModel({r[0]: r[1] for r in found.where("kind = 'c' and n >= 2").select("key", "n").collect()})
    if not all(any(totals[f, y] for f in range(FOLDS)) for y in (0, 1)):
        return Model({}, chars, None)
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)]
    keys = common.materialise(found.where("kind = 'w'").groupBy("key").agg(*sums), "toxicity-keys")
    k1, k0 = (" + ".join(f"n{f}{y}" for f in range(FOLDS)) for y in (1, 0))
    tried = keys.where(f"{k1} + {k0} >= 3").count()
    # only keys that may have a weight in one of the models come to the driver, which decides
    groups = [range(FOLDS), *([f for f in range(FOLDS) if f != own] for own in range(FOLDS))]
    weighty = keys.where(f"{k1} >= 3 and ({k1}) * 4 > {k0}").where(" or ".join(f"({may_weigh(totals, folds, tried)})" for folds in groups))
    counts = {r[0]: {(f, y): r[f"n{f}{y}"] for f in range(FOLDS) for y in (0, 1)} for r in weighty.collect()}
    whole, *apart = (Model(log_odds(counts, totals, folds, tried), chars, None) for folds in groups)
    got = common.materialise(once.mapInArrow(_tops(Handle(spark, pickle.dumps(apart))), "y double, a double, b double, c double"), "toxicity-weights")
    return Model(whole.weights, chars, regression(got))


def _scoring(handle, name: str):
    def run(batches):
        model = common.worker_held(("toxicity", handle.id), lambda: pickle.loads(handle.value))
        for batch in batches:
            scores = [model.score(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], name])

    return run


def annotate(docs: DataFrame, labels: DataFrame, fold: int = 5, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The rows with their score and decision in columns of these names, which the table doesn't have."""
    spark = docs.sparkSession
    common.must_be_free(docs, names)
    held_out = F.coalesce(common.remainder("doc_id", fold) == 0, F.lit(False))
    start = common.written()
    model = Handle(spark, pickle.dumps(fit(docs.where(~held_out), labels.where(~held_out))))
    common.drop_since(start)  # the model has all that is read again
    rows = docs.withColumn(common.free_name(docs, "scored_text"), F.col("text").cast("string"))
    schema = docs.withColumn(names[0], F.lit(0.0)).schema
    return rows.mapInArrow(_scoring(model, names[0]), schema).withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted).  Labels of documents with crc32(doc_id) mod ``fold`` 0 aren't used."""
    held_out = F.coalesce(common.remainder("doc_id", fold) == 0, F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text"))
    return annotate(own, labels, fold).select("doc_id", "held_out", "score", "predicted")
