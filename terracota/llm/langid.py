"""Language of mixed texts: scripts narrow the candidates of a word, n-gram scores rank them, Viterbi labels the words.

Learning: counts of hashed character n-grams by language, over a bounded sample of the labelled documents (about
SAMPLE a language, chosen by a hash of the text), summed by Spark. A word's score for a language is the sum of its
n-grams' smoothed log-probabilities, capped below. A language is a candidate for a word if the word's script
has at least SCRIPT_SHARE of that language's letters; if none is, all
are, and the word says nothing. The best path pays SWITCH for each
change of language. Its labels are read off as max-marginals (forward best plus backward best), which are the
labels of the best path wherever that is unique.

Cases: null and empty texts and texts without a letter are `und` with score 0; without any labelled row everything is `und`;
ties go to the language first by name; a very long text's words become numbers, 4 bytes each, and the path is found in chunks of
CHUNK words, in time and memory linear in the languages; rows that repeat get equal answers; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracota.llm.common import by_text, held_out, shared

SAMPLE, BUCKETS, ORDERS, SMOOTH = 1500, 1 << 16, (1, 2, 3, 4), 0.5
SWITCH, FLOOR, SCRIPT_SHARE, LANE, CHUNK, LONG, MEMO = 12.0, -40.0, 0.01, 128, 200_000, 1_000_000, 150_000
#: Runs of letters and of such numbers as ² and ½, which `split_words` takes out.
WORD = re.compile(r"[^\W\d_]+")
#: First code points of script ranges, as Unicode has them, and the names. Fixed values.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0x20000, "han"), (0x32000, "other"))
STARTS, NAMES = np.array([s for s, _ in SCRIPTS]), sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])


def split_words(text: str | None) -> Iterator[str]:
    """The runs of letters of a text, lower-cased. Of a long text they come one by one, without a list of all."""
    low = (text or "").lower()
    found = (m[0] for m in WORD.finditer(low)) if len(low) > LONG else WORD.findall(low)
    if len(low) <= LONG and all(map(str.isalpha, found)):
        return iter(found)
    return (x for w in found for x in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()))


def word_places(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the words of split_words, in code points of the text as it is."""
    low = text.lower()
    # a letter's lower case may have more code points than the letter
    ends = np.cumsum([len(c.lower()) for c in text]) if len(low) != len(text) else None
    for m in WORD.finditer(low):
        at = m.start()
        for alpha, run in groupby(m[0], str.isalpha):
            n = sum(1 for _ in run)
            if alpha:
                yield (at, at + n) if ends is None else (int(np.searchsorted(ends, at, "right")), int(np.searchsorted(ends, at + n - 1, "right")) + 1)
            at += n


def places(text: str, states: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, state) of the runs of words with one state; states: one a word."""
    cuts = np.flatnonzero(states[1:] != states[:-1]) + 1
    if not len(cuts):  # from the first letter to the last
        first = next(i for i, c in enumerate(text) if c.lower()[0].isalpha())
        last = next(i for i in range(len(text), 0, -1) if any(map(str.isalpha, text[i - 1].lower())))
        return [(first, last, int(states[0]))]
    begins, out = {0, *cuts.tolist()}, []
    for i, (s, e) in enumerate(word_places(text)):
        if i in begins:
            out.append((s, e, int(states[i])))
        else:
            out[-1] = (out[-1][0], e, out[-1][2])
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, n-gram bucket) of each n-gram of each word with its ends marked, and each word's script."""
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    end = points == 10
    owner = np.cumsum(end) - 1  # the mark before a word counts as the word's
    script = SCRIPT_OF[np.searchsorted(STARTS, points[1:][end[:-1]], "right") - 1]
    at, bucket = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        h = np.full(m, n, np.uint64)
        inside = np.ones(m, bool)
        for i in range(n):
            h = (h ^ points[i : m + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1 or n == 1:
                inside &= ~end[i : m + i]
        keep = np.flatnonzero(inside & ~((n == 2) & end[:m] & end[1 : m + 1] if n == 2 else np.zeros(m, bool)))
        at.append(owner[keep])
        bucket.append(h[keep] % np.uint64(BUCKETS))
    return np.concatenate(at), np.concatenate(bucket).astype(np.int64), script


def _run(scores: np.ndarray, first: np.ndarray, entry: np.ndarray, switch: float) -> np.ndarray:
    """Best score of a path that ends in each state at each word, less the greatest of them. scores (n, states); first: words that begin a text.

    entry: those of the word before. Lanes of LANE words run side by side from all states alike; where the lane before ends otherwise,
    a lane is run again from there until both runs agree, which is soon, as old words don't matter for long. Time and memory are
    linear in the words and in the states.
    """
    n, k = scores.shape
    lanes = -(-n // LANE)
    s = np.zeros((lanes * LANE, k), scores.dtype)
    s[:n] = scores
    s = np.ascontiguousarray(s.reshape(lanes, LANE, k).transpose(1, 0, 2))  # [word, lane, state]
    new = np.zeros(lanes * LANE, bool)
    new[:n] = first
    new = np.ascontiguousarray(new.reshape(lanes, LANE).T)
    any_new, low = new.any(1), scores.dtype.type(-switch)

    def step(t, now, own):
        now = np.maximum(now, low)
        if any_new[t]:
            now[new[t, own]] = 0
        now += s[t, own]
        now -= now.max(1, keepdims=True)
        return now

    out, entered = np.empty_like(s), np.zeros((lanes, k), scores.dtype)
    entered[0] = entry
    now, every = entered, slice(None)
    for t in range(LANE):
        out[t] = now = step(t, now, every)
    redo = np.arange(1, lanes)
    while len(redo := redo[(out[-1, redo - 1] != entered[redo]).any(1)]):
        now = entered[redo] = out[-1, redo - 1]
        own, changed = redo, []
        for t in range(LANE):
            now = step(t, now, own)
            other = (out[t, own] != now).any(1)
            own, now = own[other], now[other]
            if not len(own):
                break
            out[t, own] = now
        else:
            changed = own
        redo = np.array([x + 1 for x in changed if x + 1 < lanes], np.int64)
    return out.transpose(1, 0, 2).reshape(lanes * LANE, k)[:n]


def labels(scores, n: int, k: int, first: np.ndarray, switch: float = SWITCH, chunk: int | None = None) -> np.ndarray:
    """State of each of n words on the best path; scores(a, b): those of words a to b, (b - a, k). first: words that begin a text.

    Chunk by chunk: forward over all, keeping what each chunk begins from, then backward with each chunk's forward run again, so
    memory grows with the words by a byte or so each, whatever the states.
    """
    chunk = chunk or CHUNK
    starts = range(0, n, chunk)
    entries, last, out = [np.zeros(k, np.float32)], np.append(first[1:], True), np.empty(n, np.uint16)
    for at in starts[:-1]:
        entries.append(_run(scores(at, at + chunk), first[at : at + chunk], entries[-1], switch)[-1])
    after = np.zeros(k, np.float32)
    for at, entry in zip(reversed(starts), reversed(entries), strict=True):
        own = scores(at, min(n, at + chunk))
        ahead = _run(own, first[at : at + len(own)], entry, switch)
        back = _run(own[::-1], last[at : at + len(own)][::-1], after, switch)[::-1]
        after = back[0]
        # both are best scores but for a constant of the word, the same for all states
        out[at : at + len(own)] = (ahead + back - own).argmax(1)
    return out


class Memo(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, scripts: np.ndarray):
        self.langs, self.weights, self.scripts, self.memo = langs, weights, scripts, Memo()
        self.rows, self.sizes = np.empty((0, len(langs)), np.float32), np.empty(0, np.int64)

    def scores(self, words: list[str]) -> np.ndarray:
        at, bucket, script = grams(words)
        order = np.argsort(at, kind="stable")
        sums = np.add.reduceat(self.weights[bucket[order]], np.searchsorted(at[order], np.arange(len(words))), axis=0)
        sums = np.maximum(sums - sums.max(1, keepdims=True), FLOOR)
        fits = self.scripts[script]
        return np.where(fits.any(1, keepdims=True), np.where(fits, sums, FLOOR), 0).astype(np.float32)

    def _ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Number of each word of each text in the memo. Words are taken some at a time, so that they need no list of all."""
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.rows, self.sizes = np.empty((0, len(self.langs)), np.float32), np.empty(0, np.int64)
        memo, out, start = self.memo, [], len(self.memo)
        for t in texts:
            out.append(np.fromiter(map(memo.__getitem__, split_words(t)), np.int32))
        new = list(islice(memo, start, None))
        parts = [self.scores(new[at : at + CHUNK]) for at in range(0, len(new), CHUNK)]
        self.rows = np.concatenate([self.rows, *parts])
        self.sizes = np.append(self.sizes, [len(w) for w in new]).astype(np.int64)
        return out

    def _path(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each text's word numbers, and the states of all words."""
        ids = self._ids(texts)
        sizes, every = np.array([len(x) for x in ids]), np.concatenate([*ids, np.empty(0, np.int32)])
        first = np.zeros(len(every), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return ids, labels(lambda a, b: self.rows[every[a:b]], len(every), len(self.langs), first) if len(every) else np.empty(0, np.uint16)

    def label(self, texts: list[str | None]) -> list[list[tuple[str, str]]]:
        """Spans' raw form: each text's (word, language)."""
        ids, states = self._path(texts)
        words, out, at = list(self.memo), [], 0
        for own in ids:
            out.append([(words[w], self.langs[i]) for w, i in zip(own.tolist(), states[at : at + len(own)].tolist(), strict=True)])
            at += len(own)
        return out

    def predict(self, texts: list[str | None]) -> dict:
        if not self.langs:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "spans": [0] * len(texts), "languages": [""] * len(texts)}
        ids, states = self._path(texts)
        out, at = {"lang_pred": [], "score": [], "spans": [], "languages": []}, 0
        for text, words in zip(texts, ids, strict=True):
            own = states[at : at + len(words)]
            at += len(words)
            if not len(words):
                best, score, found = "und", 0.0, []
            else:
                letters = np.bincount(own, weights=self.sizes[words], minlength=len(self.langs))
                i = int(letters.argmax())
                total = sum(self.rows[words[x : x + CHUNK]].sum(0, dtype=np.float64) for x in range(0, len(words), CHUNK)) / np.sqrt(len(words))
                sure = 1 / np.exp(np.minimum(total - total[i], 50)).sum()
                best, score, found = self.langs[i], float(letters[i] / letters.sum() * sure), places(text, own)
            languages = ",".join(f"{s}:{e}:{self.langs[k]}" for s, e, k in found)
            for key, v in (("lang_pred", best), ("score", score), ("spans", len(found)), ("languages", languages)):
                out[key].append(v)
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Model from about sample documents a language; languages of fewer give all they have. Rows held out are never read."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).where(~held_out(F.col("id")) & F.col("lang").isNotNull() & (F.col("lang") != "und"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return Model([], np.empty((0, 0)), np.empty((0, 0), bool))
    langs = sorted(counts)
    share = F.coalesce(*(F.when(F.col("lang") == k, sample / n) for k, n in counts.items() if n > sample), F.lit(1.0))
    chosen = rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")

    def count(batches):
        total = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words = [w for t in texts if isinstance(t, str) for w in split_words(t)]
                for at in range(0, len(words), 200_000):
                    _, bucket, script = grams(words[at : at + 200_000])
                    total[lang] = total.get(lang, 0) + np.concatenate([np.bincount(bucket, minlength=BUCKETS), np.bincount(script, minlength=len(NAMES))])
        for lang, c in total.items():
            found = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "slot": found, "n": c[found]})

    by_text(docs.sparkSession, lambda: None, "x long")  # sets the batch size
    found = chosen.mapInPandas(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    c = np.zeros((BUCKETS + len(NAMES), len(langs)))
    c[found["slot"].to_numpy(), found["lang"].map(langs.index).to_numpy(np.int64)] = found["n"]
    w = c[:BUCKETS] + SMOOTH
    scripts = c[BUCKETS:]
    return Model(langs, np.log(w / w.sum(0)).astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct column (lang_pred, score, spans, languages): languages has the spans as start:end:language by commas, in code points, ends exclusive; spans counts them. The model, bounded by BUCKETS and the languages, is broadcast."""
    own = shared(docs.sparkSession, model)
    return by_text(docs.sparkSession, lambda: own().predict, "lang_pred string, score double, spans long, languages string")(F.col(text_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans, languages) for each row."""
    found = predicted(docs, learn(docs, id_col, text_col, lang_col, sample), text_col)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), found.alias("r")).select("doc_id", "held_out", "r.*")
