"""Language identification by cross-parsing entropy.

For each language, a suffix automaton holds a bounded sample of labelled text. A whole text is parsed against it greedily:
from each place the longest match with any part of the sample is one phrase, over as many words as it goes, and an unknown
character is a phrase alone. The language that needs the fewest phrases per character has the lowest cross-parsing entropy
and wins. Samples and texts are lower-cased, and every run of characters other than letters and marks is one space.

The sample: of each language, the row of smallest hash in each of sample_rows hash buckets, and of each such text one
piece of at most piece_chars characters, at a place in the text that the hash chooses. Fitting reads all rows' labels and
only these rows' texts, and brings at most sample_rows * piece_chars characters of a language to the driver.

Defined results: text that is null or has no letter is 'und' with score 0; ties go to the smaller language name; with no
labelled rows (an empty table, too) everything is 'und'; a very long text is parsed whole, in time linear in its length
and with nothing kept but counts; repeated rows are judged one by one; an existing column of an output's name is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnline.llm.shared import held, ready

UNKNOWN = "und"
SAMPLE_ROWS, PIECE_CHARS = 64, 400
RESULT = "struct<lang_pred: string, score: double, phrases_per_char: double>"
_LETTER = regex.compile(r"\p{L}").search
_LETTERS = regex.compile(r"[\p{L}\p{M}]+").findall
_BETWEEN = "\n"  # between the pieces of a sample; no text that is parsed holds it


def letters(text: str) -> str:
    """The text in lower case, its runs of letters and marks with one space before each."""
    return "".join([f" {run}" for run in _LETTERS(text.lower())])


class SuffixAutomaton:
    """The substrings of a text; a state is the dict of its transitions by character."""

    def __init__(self, text: str):
        states: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        number = {id(states[0]): 0}
        for char in text:
            new = len(states)
            states.append({})
            number[id(states[new])] = new
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and char not in states[p]:
                states[p][char] = states[new]
                p = link[p]
            if p >= 0:
                q = number[id(states[p][char])]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(states)
                    states.append(dict(states[q]))
                    number[id(states[copy])] = copy
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and states[p].get(char) is states[q]:
                        states[p][char] = states[copy]
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.root = states[0]

    def phrases(self, text: str) -> int:
        """Greedy longest matches that cover text."""
        root = state = self.root
        count = 0
        for char in text:
            if (to := state.get(char)) is not None:
                state = to
                continue
            count += 1  # the match ends before char
            if state is not root and (state := root.get(char)) is None:
                count += 1  # and char is unknown
                state = root
        return count + (state is not root)


class Model:
    """The automata of all languages."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        self.automata = [SuffixAutomaton(text) for _, text in samples]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        if not text or not self.langs or not _LETTER(text):
            return UNKNOWN, 0.0, 0.0
        parsed = letters(text)
        totals = np.array([a.phrases(parsed) for a in self.automata])
        best = int(totals.argmin())
        rest = np.delete(totals, best)
        # the share by which the next language needs more phrases
        score = 1.0 - totals[best] / rest.min() if len(rest) and rest.min() else float(not len(rest))
        return self.langs[best], float(score), float(totals[best] / len(parsed))


def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return held(Model, samples)


def fit_samples(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, piece_chars: int = PIECE_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, sample) pairs, ordered by language."""
    rows = labelled.select(F.col(key_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("key is not null and lang is not null and text is not null")
    hashed = F.xxhash64("key", F.lit(7))
    picked = rows.groupBy("lang", F.pmod(hashed, F.lit(sample_rows)).alias("bucket")).agg(F.min_by("key", hashed).alias("key"))
    picked = F.broadcast(picked.select("lang", "key"))  # sample_rows keys of each language
    places = F.greatest(F.lit(1), F.ceil(F.length("text") / piece_chars))
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("key", F.lit(8)), places) * piece_chars + 1).cast("int"), F.lit(piece_chars))
    # rows that share a key give one piece
    texts = rows.join(picked, ["lang", "key"], "left_semi").groupBy("lang", hashed.alias("hash")).agg(F.min(piece).alias("piece"))
    found = sorted(map(tuple, texts.collect()))
    samples = ((lang, _BETWEEN.join(letters(t) for _, _, t in group)) for lang, group in groupby(found, key=lambda r: r[0]))
    return tuple((lang, text) for lang, text in samples if text.strip())


def language(text: Column | str, samples: tuple[tuple[str, str], ...]) -> Column:
    """struct of lang_pred, score (0 to 1) and phrases_per_char."""

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        rows = list(map(_model(samples).judge, (t.as_py() for t in texts)))
        columns = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "phrases_per_char"])

    return judge(text)


def with_language(df: DataFrame, samples: tuple[tuple[str, str], ...], text_col: str = "text", out: str = "language") -> DataFrame:
    ready(df.sparkSession)
    return df.withColumn(out, language(F.col(text_col), samples))
