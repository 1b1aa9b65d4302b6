"""Language identification by cross-parsing against suffix automata.

A sample of labelled text of each language becomes a suffix automaton, which
accepts exactly the sample's substrings. A text is parsed greedily into the longest
phrases that an automaton accepts, a letter that it doesn't have being a phrase of its own; a phrase costs
about the logarithm of the sample's length, so the language of the fewest phrases, so normalised, wins. Automata are dense
arrays, and a batch of texts, cut into lanes, walks through all of them in lockstep. Lanes first start at the
root, and are then corrected from the state in which the lane before ended until both walks meet, so
the parse is that of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalink.llm.shared import documents, held, held_out, slices, stored

UNDETERMINED = "und"
STRANGER = 1.7  #: times as many phrases a letter as the 0.99 quantile are those of a language not learnt
ROOM = 6  #: phrases that a text of any length may have besides; the fewer letters, the more this allows


@dataclass(frozen=True)
class Parsing:
    rows: int = 200  #: texts of a language, at most, in the sample
    excerpt: int = 2000  #: code points of each, at a place picked by hash, that the sample takes at most
    letters: int = 40_000  #: code points of a language, at most, in its automaton, drawn evenly from its excerpts
    alphabet: int = 64  #: symbols; if the samples have more letters, the rarer ones are written as two or three
    lane: int = 1024  #: letters that one column of a batch walks through; the result doesn't depend on it
    bits: float = 4.0  #: by which a language must be cheaper to be e times as likely


def automaton(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Transitions (states, alphabet) of the suffix automaton; 0 is the root, and means none."""
    size = 2 * len(text) + 2
    to: list[dict[int, int]] = [{}]
    link, length = [-1] + [0] * (size - 1), [0] * size
    last = 0
    for c in text.tolist():
        new = len(to)
        to.append({})
        length[new] = length[last] + 1
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length[copy], link[copy] = length[p] + 1, link[q]
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out = np.zeros((len(to), alphabet), np.int32)
    for state, d in enumerate(to):
        for c, s in d.items():
            out[state, c] = s
    return out


def _codes(letters: int, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, how many of them) of 0, 1 and each letter from 2 on; the commonest letters have one, no two the same."""
    trail = leads = 0
    while symbols - leads + leads * symbols**trail * (trail > 0) < letters:
        trail, leads = (trail, leads + 1) if trail and leads < symbols // 2 else (trail + 1, 1)
    single = min(letters, symbols - leads)
    codes, lengths = np.zeros((letters + 2, trail + 1), np.uint8), np.ones(letters + 2, np.int64)
    codes[1, 0] = 1
    codes[2 : single + 2, 0] = np.arange(single) + 2
    if letters > single:
        rest = np.arange(letters - single)
        codes[single + 2 :, 0] = rest // symbols**trail + 2 + symbols - leads
        for k in range(trail):
            codes[single + 2 :, 1 + k] = rest // symbols ** (trail - 1 - k) % symbols + 2
        lengths[single + 2 :] = trail + 1
    return codes, lengths


def even(texts: list[str], letters: int) -> list[str]:
    """As much of each text as all may have for ``letters`` code points together."""
    left, share = letters, 0
    for i, n in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - i)
        if n > share:
            break
        left, share = left - n, n
    return [t[:share] for t in texts]


class Languages:
    """Automata of several languages, and the numbers that letters have in them."""

    def __init__(self, samples: tuple[tuple[str, str], ...], how: Parsing):
        self.how, self.names = how, [n for n, _ in samples]
        seen: dict[str, int] = {}
        for _, text in samples:
            for c in text.lower():
                if c.isalpha():
                    seen[c] = seen.get(c, 0) + 1
        own = sorted(seen, key=lambda c: (-seen[c], c))
        # 0: anything but a letter; 1: a letter that no sample has; others: a row of ``codes``, of symbols from 2 on
        self.codes, self.lengths = _codes(len(own), how.alphabet - 2)
        self.number = np.zeros(0x110000, np.uint32)
        known = {c: i + 2 for i, c in enumerate(own)}
        for cp in range(0x110000):
            if (c := chr(cp)).isalpha():
                self.number[cp] = known.get(c.lower()[:1], 1)
        for c, i in known.items():
            self.number[ord(c)] = i
        texts = [self.numbers(t) for _, t in samples]
        self.width = int(self.codes.max()) + 1  # symbols in use
        tables = [automaton(t, self.width) for t in texts]
        self.base = (np.concatenate([[0], np.cumsum([len(t) for t in tables])[:-1]]) * self.width).astype(np.int64)[:, None]
        self.table = np.concatenate([t.ravel() for t in tables]) if tables else np.zeros(0, np.int32)
        self.cost = np.log2(np.array([len(t) for t in texts]) + 2.0)

    def numbers(self, text: str) -> np.ndarray:
        """Letters by symbols, anything between them as one 0."""
        n = self.number[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        keep = n != 0
        keep[1:] |= n[:-1] != 0
        n = n[keep]
        if self.codes.shape[1] == 1:
            return n.astype(np.uint8)
        return self.codes[n][np.arange(self.codes.shape[1]) < self.lengths[n][:, None]]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(languages, texts): phrases of each text's greedy parse."""
        lane, many = self.how.lane, len(self.names)
        parts = [-(-len(t) // lane) for t in texts]
        total = sum(parts)
        if not total:
            return np.zeros((many, len(texts)))
        of = np.repeat(np.arange(len(texts)), parts)
        sizes = np.array([min(lane, len(t) - lo) for t in texts for lo in range(0, len(t), lane)], np.int64)
        grid = np.zeros((min(lane, int(sizes.max())), total), np.uint8)
        at = 0
        for t, n in zip(texts, parts):
            if n:
                padded = np.zeros(n * len(grid), np.uint8)  # a text of several lanes fills the grid's height
                padded[: len(t)] = t
                grid[:, at : at + n] = padded.reshape(n, len(grid)).T
                at += n
        order = np.argsort(-sizes, kind="stable")
        count, state = np.zeros((many, total), np.int64), np.zeros((many, total), np.int32)
        sorted_grid, found, now = grid[:, order], np.zeros((many, total), np.int64), np.zeros((many, total), np.int32)
        active = np.searchsorted(-sizes[order], -np.arange(len(grid)), "left")  # lanes longer than each step
        for c, k in zip(sorted_grid, active.tolist()):
            c, old = c[:k], now[:, :k]
            to = self.table[self.base + old * np.int64(self.width) + c]
            none = to == 0
            found[:, :k] += none | (old == 0)
            now[:, :k] = np.where(none, self.table[self.base + c], to)
        count[:, order], state[:, order] = found, now
        self._settle(grid, sizes, np.concatenate([[False], of[1:] == of[:-1]]), count, state)
        return np.stack([np.bincount(of, row, len(texts)) for row in count]) if many else np.zeros((0, len(texts)))

    def _settle(self, grid: np.ndarray, sizes: np.ndarray, follows: np.ndarray, count: np.ndarray, state: np.ndarray) -> None:
        """Correct ``count`` and ``state`` of lanes that follow another one, walked from the root, for the state in which that one ended."""
        table, base, width = self.table, self.base[:, 0], np.int64(self.width)
        more, entry = np.zeros_like(count), np.zeros_like(state)  # phrases to be added, and the state they were found for
        ends = state.copy()  # of the walks from the root
        while True:
            want = np.zeros_like(state)
            want[:, 1:] = np.where(follows[1:], state[:, :-1], 0)
            lang, lane = np.nonzero(want != entry)
            if not len(lang):
                break
            entry = want
            a, b = np.zeros(len(lang), np.int32), want[lang, lane]
            extra, step = np.zeros(len(lang), np.int64), 0
            while len(lang):
                over = (a == b) | (sizes[lane] <= step)
                if over.any():
                    done = lang[over], lane[over]
                    more[done] = extra[over]
                    state[done] = np.where(a[over] == b[over], ends[done], b[over])
                    lang, lane, a, b, extra = (x[~over] for x in (lang, lane, a, b, extra))
                    if not len(lang):
                        break
                c = grid[step, lane]
                root = table[base[lang] + c]
                for walk, sign in ((a, -1), (b, 1)):
                    to = table[base[lang] + walk * width + c]
                    none = to == 0
                    extra += sign * (none | (walk == 0))
                    walk[:] = np.where(none, root, to)
                step += 1
        count += more

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, likelihood among the languages, phrases a letter) of each text."""
        if not self.names:
            return [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        numbers = [self.numbers(t or "") for t in texts]
        known = [bool(n.any()) for n in numbers]
        numbers = [n if k else n[:0] for n, k in zip(numbers, known)]
        phrases = self.phrases(numbers)
        bits = phrases * self.cost[:, None]
        best = bits.argmin(0)
        odds = 1 / np.exp((bits.min(0) - bits) / self.how.bits).sum(0)
        return [
            (self.names[b], float(min(o, 1.0)), float(phrases[b, i] / max(1, len(numbers[i])))) if known[i] else (UNDETERMINED, 0.0, 0.0)
            for i, (b, o) in enumerate(zip(best, odds))
        ]


def languages(samples: tuple[tuple[str, str], ...], how: Parsing) -> Languages:
    """Built once in a worker, kept between tasks."""
    return held((samples, how), lambda: Languages(samples, how))


def excerpts(docs: DataFrame, how: Parsing = Parsing()) -> list[tuple[str, list[str]]]:
    """(language, texts) of the languages: a bounded sample of rows that are not held out, picked by hash of the text.

    Every language is learnt. At most ``rows`` excerpts a language of ``excerpt`` code points, each from a place
    of its text that the hash picks, reach the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", F.xxhash64("text").alias("h"), "text")
    common = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("d")).select("lang", "d")
    # a share of the hashes that leaves about four times the texts wanted, so a language of very many texts is no large window
    low = F.pmod("h", F.lit(1 << 31)).cast("double") * F.col("d") < float(4 * how.rows << 31)
    slim = rows.select("lang", "h").join(F.broadcast(common), "lang").where(low).select("lang", "h").distinct()
    picked = stored(slim.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= how.rows).drop("k"), "picked")
    place = F.expr(f"cast(pmod(h, greatest(char_length(text) - {how.excerpt}, 0) + 1) + 1 as int)")
    texts = rows.withColumn("text", F.substr("text", place, F.lit(how.excerpt))).join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect()
    out: dict[str, list[str]] = {}
    for r in texts:
        out.setdefault(r["lang"], []).append(r["text"])
    return [(lang, even(t, how.letters)) for lang, t in sorted(out.items())]


def joined(texts: list[tuple[str, list[str]]]) -> tuple[tuple[str, str], ...]:
    return tuple((lang, "\n".join(t)) for lang, t in texts)


def sampled(docs: DataFrame, how: Parsing = Parsing()) -> tuple[tuple[str, str], ...]:
    """(language, text) of the languages, of ``excerpts``."""
    return joined(excerpts(docs, how))


def limits(texts: list[tuple[str, list[str]]], most: float, how: Parsing = Parsing()) -> dict[str, float]:
    """Phrases a letter, beyond ``ROOM``, that texts of each language may have: ``STRANGER`` times what 99 % of its excerpts need.

    Each half of the excerpts is judged by what the other half teaches. A language of a single
    excerpt has the largest limit of the others, ``most`` if there is none.
    """
    rates: dict[str, list[float]] = {}
    for half in (0, 1):
        model = Languages(joined([(lang, t[half::2]) for lang, t in texts if len(t) > 1]), how)
        for i, lang in enumerate(model.names):
            numbers = [n for t in dict(texts)[lang][1 - half :: 2] if len(n := model.numbers(t))]
            if numbers:
                phrases = model.phrases(numbers)[i]
                rates.setdefault(lang, []).extend(np.maximum(phrases - ROOM, 0) / [len(n) for n in numbers])
    found = {lang: STRANGER * float(np.quantile(r, 0.99)) for lang, r in rates.items()}
    return {lang: found.get(lang, max(found.values(), default=most)) for lang, _ in texts}


def identified(docs: DataFrame, how: Parsing = Parsing()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, phrases``, a row for each row of ``docs`` (doc_id, text, lang).

    ``score`` is the language's likelihood among the learnt ones, ``phrases`` its phrases a letter. Null
    texts and texts without a letter (``str.isalpha``) are ``und`` at score 0, as is all if no row has a language. Ties go to
    the first language by name. Long texts are parsed whole. Rows repeat as they do in ``docs``; other columns are
    ignored; an empty table gives no row.
    """
    samples = docs.sparkSession.sparkContext.broadcast(sampled(docs, how))

    def run(batches):
        model = languages(samples.value, how)
        for batch in batches:
            for part in slices(batch, 1, 500, 2 << 20):
                found = model.judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in zip(*found))], ["doc_id", "lang_pred", "score", "phrases"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, phrases double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "phrases")


def in_known_language(docs: DataFrame, most: float = 0.7, how: Parsing = Parsing()) -> DataFrame:
    """The rows of ``docs`` that have letters and of which the best language needs no more phrases than ``limits`` and ``ROOM`` allow.

    Null texts and those without a letter go, as does every row if none has a language. Rows of equal text share their fate, whatever
    their other columns, which all stay; an empty table stays empty.
    """
    texts = excerpts(docs, how)
    samples = docs.sparkSession.sparkContext.broadcast(joined(texts))
    limit = limits(texts, most, how)

    def run(batches):
        model = languages(samples.value, how)

        def fits(name, rate, text):
            return name != UNDETERMINED and (rate <= limit[name] or (rate - limit[name]) * len(model.numbers(text)) <= ROOM)

        for batch in batches:
            at = batch.schema.names.index("text")
            for part in slices(batch, at, 500, 2 << 20):
                texts = part.column(at).to_pylist()
                keep = [fits(n, p, t) for (n, _, p), t in zip(model.judge(texts), texts)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(documents(spark, sf_dir))
