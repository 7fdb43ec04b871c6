"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, at any place of a
new text, the longest match with that language's text. Parsing the new text
greedily into longest matches takes few, long phrases in its own language and
many short ones elsewhere; phrases times the log of the training length, per
character, estimates the cross entropy (Ziv and Merhav), and the least wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_arrow, ship

#: Bounds of the training sample, per language: rows, characters of one row, characters.
SAMPLE_ROWS, ROW_CHARS, LANGUAGE_CHARS = 64, 4_000, 40_000
#: Bounds for all languages together: the labels learned (the most frequent ones), and characters.
#: The parsing table has at most 2 states of 256 bytes a symbol, usually 1.4.
MAX_LANGUAGES, TOTAL_CHARS = 256, 400_000
#: Letters with a symbol of their own. Every other letter is spelled by the
#: hexadecimal digits of its code point, 4 or 6 of the symbols from DIGITS on, so
#: letters of any script stay apart. 0 stands for anything else than a letter.
ALPHABET, DIGITS, WIDTH = 46, 48, 64
#: Texts are parsed in segments of so many symbols, side by side; a segment's start begins a phrase.
SEGMENT = 256
UNDETERMINED = "und"
#: A filter accepts documents with a greater score: 0.5 is a tie of the two best languages, however many there are.
MIN_SCORE = 0.5
_CODES = 0x110000


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point, that of its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(_CODES, dtype=np.int32)
    for code in range(_CODES):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _squeezed(symbols: np.ndarray) -> np.ndarray:
    """Runs of non-letters become one."""
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    return symbols[keep]


def _spelled(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of folded code points; letters without a symbol become digits."""
    out = table[codes]
    other = np.flatnonzero(out == 1)
    if not len(other):
        return out
    places = np.where(codes[other] > 0xFFFF, 6, 4)
    times = np.ones(len(out), dtype=np.int64)
    times[other] = places
    start = (np.cumsum(times) - times)[other]
    out = np.repeat(out, times)
    for k in range(6):
        has = places > k
        out[start[has] + k] = DIGITS + ((codes[other[has]] >> (4 * k)) & 15)
    return out


def suffix_automaton(symbols, width: int) -> np.ndarray:
    """Transitions ``[state, symbol]`` of the automaton of all substrings; -1 where there is none."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        state = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    table = np.full((len(step), width), -1, dtype=np.int32)
    for state, edges in enumerate(step):
        for c, target in edges.items():
            table[state, c] = target
    return table


@dataclass
class LanguageModel:
    """``names``, the symbols of letters, and the parsing tables of all languages.

    ``tables`` has one row per state of any automaton. An entry is
    ``2 * next state + 1`` if a new phrase begins with this symbol, otherwise
    ``2 * next state``. ``roots`` are the states that parsing starts from.
    """

    names: list[str]
    symbols: dict[int, int]
    tables: np.ndarray
    roots: np.ndarray
    sizes: np.ndarray

    @classmethod
    def train(cls, samples: dict[str, str]) -> LanguageModel:
        folded = _folded()
        texts = {name: folded[_codes(text)] for name, text in sorted(samples.items())}
        texts = {name: t for name, t in texts.items() if t.any()}
        if not texts:
            return cls([], {}, np.empty((0, WIDTH), dtype=np.int32), np.empty(0, dtype=np.int32), np.empty(0))
        # Every language has the same say in which letters get a symbol.
        share = np.zeros(_CODES)
        for t in texts.values():
            own = np.bincount(t[t > 0], minlength=_CODES)
            share += own / own.sum()
        top = np.argsort(-share, kind="stable")[:ALPHABET]
        symbols = {int(c): i + 2 for i, c in enumerate(top[share[top] > 0])}
        coded = lookup(symbols)
        parts, roots, sizes, base = [], [], [], 0
        for t in texts.values():
            s = _squeezed(_spelled(t, coded))
            raw = suffix_automaton(s.tolist(), WIDTH)
            start = np.where(raw[0] >= 0, raw[0], 0)
            table = np.where(raw >= 0, 2 * (raw + base), 2 * (start[None, :] + base) + 1)
            table[0] |= 1  # whatever leaves the root begins a phrase
            parts.append(table.astype(np.int32))
            roots.append(base)
            sizes.append(len(s))
            base += len(raw)
        return cls(list(texts), symbols, np.concatenate(parts), np.array(roots, dtype=np.int32), np.array(sizes, dtype=np.float64))


def lookup(symbols: dict[int, int]) -> np.ndarray:
    """Symbol by folded code point."""
    out = np.ones(_CODES, dtype=np.uint8)
    out[0] = 0
    for code, symbol in symbols.items():
        out[code] = symbol
    return out


class Parser:
    """Counts phrases of many texts at once."""

    def __init__(self, model: LanguageModel):
        folded = _folded()
        self.model = model
        self.folded, self.coded = folded, lookup(model.symbols)
        self.flat = model.tables.reshape(-1)
        self.width = model.tables.shape[1]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases ``[text, language]`` of texts given as symbols."""
        owner, pieces = [], []
        for i, t in enumerate(texts):
            for at in range(0, len(t), SEGMENT):
                owner.append(i)
                pieces.append(t[at : at + SEGMENT])
        out = np.zeros((len(texts), len(self.model.names)))
        if not pieces:
            return out
        # Longest first, so that the lanes still running are always the first ones.
        lengths = np.array([len(p) for p in pieces])
        order = np.argsort(-lengths, kind="stable")
        lanes = np.zeros((SEGMENT, len(pieces)), dtype=np.int32)
        for lane, i in enumerate(order):
            lanes[: lengths[i], lane] = pieces[i]
        running = np.searchsorted(-lengths[order], -np.arange(SEGMENT), side="left")
        state = np.repeat(self.model.roots[:, None], len(pieces), axis=1).astype(np.int64)
        count = np.zeros(state.shape, dtype=np.int32)
        for step in range(SEGMENT):
            n = running[step]
            if not n:
                break
            entry = self.flat[state[:, :n] * self.width + lanes[step, :n]]
            count[:, :n] += entry & 1
            state[:, :n] = entry >> 1
        np.add.at(out, np.array(owner)[order], count.T)
        return out

    def symbols(self, text: str) -> np.ndarray:
        return _squeezed(_spelled(self.folded[_codes(text)], self.coded))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """``(language, score, bits per symbol)`` of each text."""
        coded = [self.symbols(t) if t else np.empty(0, dtype=np.uint8) for t in texts]
        coded = [t if t.any() else t[:0] for t in coded]
        if not self.model.names:
            return [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        bits = self.phrases(coded) * np.log2(self.model.sizes)[None, :]
        out = []
        for t, row in zip(coded, bits, strict=True):
            if not len(t):
                out.append((UNDETERMINED, 0.0, 0.0))
                continue
            best = int(np.argmin(row))
            # Against the second best alone: 0.5 if both parse alike, near 1 if the best stands out.
            second = np.partition(row, 1)[1] if len(row) > 1 else np.inf
            out.append((self.model.names[best], float(1 / (1 + (row[best] / second) ** 4)), float(row[best] / len(t))))
        return out


def held_out(id_col: str) -> Column:
    """Documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """A bounded sample of labelled text per language, the same for the same table.

    Per language at most SAMPLE_ROWS rows, those of least id hash, at most
    ROW_CHARS characters of each and LANGUAGE_CHARS in all. Of more than
    MAX_LANGUAGES labels the most frequent are learned, and where many share
    TOTAL_CHARS, each has less. Held-out rows and rows with a null id, text or
    language are never read; an empty table gives an empty sample. Spark keeps
    only each task's best rows before the shuffle, so no language is hot.
    """
    usable = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    names = [r["lang"] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES).collect()]
    most = min(LANGUAGE_CHARS, TOTAL_CHARS // max(1, len(names)))
    rows = usable.filter(F.col(lang_col).isin(names)).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.substring(text_col, 1, min(ROW_CHARS, most)).alias("text"))
    order = W.partitionBy("lang").orderBy("h", "text")
    picked = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= SAMPLE_ROWS).orderBy("lang", "nth").collect()
    out: dict[str, str] = {}
    for row in picked:
        out[row["lang"]] = (out.get(row["lang"], "") + "\n" + row["text"])[:most]
    return out


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``(id_col, lang_pred, score, bits)``; no shuffle.

    A text that is null or without a letter is ``und`` with score 0. The whole
    text is parsed. Texts of any length take bounded memory beyond themselves.
    Ties between languages go to the first name; extra columns are not read.
    """
    shared = _share(df, model)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for part, found in _predicted(batches, 1, shared.value):
            cols = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.float64()), strict=True)]], [id_col, "lang_pred", "score", "bits"])

    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {id_type}, lang_pred string, score double, bits double")


def _share(df: DataFrame, model: LanguageModel):
    # Bounded: TOTAL_CHARS fixes the states of all automata together.
    return df.sparkSession.sparkContext.broadcast(model)


def _predicted(batches, column: int, model: LanguageModel):
    """Parts of the batches of about 2 MB of text, and the predictions for each."""
    parser = Parser(model)
    for batch in batches:
        texts, at = batch.column(column), 0
        while at < batch.num_rows:
            end, size = at, 0
            while end < batch.num_rows and size < 1 << 21:
                size += texts[end].as_buffer().size if texts[end].is_valid else 0
                end += 1
            part = batch.slice(at, end - at)
            yield part, parser.predict(part.column(column).to_pylist())
            at = end


def accepted(df: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``df``, all columns, whose language is determined with a score over ``min_score``; no shuffle.

    Rows whose text is null, empty or without a letter go; if no language was
    learned, all go. Repeated rows share their fate, ties between the two best
    languages go, and an empty table stays empty. Texts of any
    length are parsed whole. Columns may have any names but that of the text.
    """
    shared, column = _share(df, model), df.columns.index(text_col)

    def run(batches):
        for part, found in _predicted(batches, column, shared.value):
            yield part.filter(pa.array([lang != UNDETERMINED and score > min_score for lang, score, _ in found]))

    ship(df.sparkSession)
    return df.mapInArrow(run, df.schema)
