"""Quality rules by weak supervision (operator 2).

Each rule reads a text's statistics and votes junk, good, or abstains. Expectation-maximisation over the counts of vote
patterns estimates the class prior and each rule's vote rates within both classes (its accuracies), without labels. A
document's verdict is its posterior probability of being good, so one rule that is often wrong cannot reject it alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scanweave.llm import _text
from scanweave.llm._scratch import keep, small_batches

U64 = np.uint64
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_letters", "n_capitals", "n_stops", "n_bare", "word_bytes")
_TABLES = {name: np.zeros(256, bool) for name in ("n_symbols", "n_exclaims", "n_letters", "n_capitals")}
_TABLES["n_symbols"][[*b"#*$%&|<>"]] = True
_TABLES["n_exclaims"][[*b"!"]] = True
_TABLES["n_capitals"][65:91] = True
_TABLES["n_letters"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[*b".,;:!?"]] = True


@dataclass(frozen=True)
class Rule:
    """Votes junk where `junk` holds, good where `good` holds, else abstains. Both are SQL over the statistics."""

    name: str
    junk: str
    good: str


RULES = (
    Rule("symbols", "n_symbols > 0.15 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("exclaims", "n_exclaims > 0.3 * n_words", "n_exclaims <= 0.05 * n_words"),
    Rule("capitals", "n_capitals > 0.4 * n_letters", "n_capitals <= 0.15 * n_letters"),
    Rule("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    Rule("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    Rule("letters", "n_letters < 0.75 * word_bytes", "n_letters >= 0.85 * word_bytes"),
    Rule("bare", "n_bare > 0.1 * n_words", "n_bare <= 0.03 * n_words"),
    Rule("stops", "n_stops < 0.01 * n_words", "n_stops >= 0.04 * n_words"),
    Rule("length", "word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
)


def statistics(texts: _text.Texts) -> dict[str, np.ndarray]:
    """The statistics of each row."""
    starts, ends, rows = texts.words()
    n = texts.n
    per_row = lambda at, weights=None: np.bincount(at, weights, minlength=n).astype(np.int64)
    out = {"n_words": per_row(rows)}
    points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    out["word_chars"] = per_row(rows, points[ends] - points[starts])
    out["word_bytes"] = per_row(rows, ends - starts)
    for name, table in _TABLES.items():
        sums = np.concatenate([[0], np.cumsum(table[texts.data])])
        out[name] = np.diff(sums[texts.offsets])
    letters = np.concatenate([[0], np.cumsum(_TABLES["n_letters"][texts.data])])
    out["n_bare"] = per_row(rows[letters[ends] == letters[starts]])
    out["n_stops"] = per_row(rows[_STOPS[texts.data[ends - 1]]]) if len(ends) else np.zeros(n, np.int64)

    first, last, line_rows = texts.lines()
    full = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    with np.errstate(over="ignore"):
        keys = _text.mix(texts.hash_spans(first[full], last[full]) + line_rows[full].astype(U64) * U64(0x632BE59BD9B4E019))
        _, at = np.unique(keys, return_index=True)
        out["n_dup_lines"] = per_row(line_rows[full]) - per_row(line_rows[full][at])
        out["n_lines"] = per_row(line_rows)

        words = texts.hash_spans(starts, ends)
        repeated = np.zeros(len(words), bool)
        if len(words) > 2:
            inside = np.flatnonzero(rows[:-2] == rows[2:])
            w = words[inside] * U64(0xD6E8FEB86659FD93) + words[inside + 1] * U64(0xA0761D6478BD642F) + words[inside + 2] * U64(0xE7037ED1A0B428DB)
            w = _text.mix(w + rows[inside].astype(U64) * U64(0x632BE59BD9B4E019))
            order = np.argsort(w)
            same = w[order][1:] == w[order][:-1]
            hit = np.zeros(len(w), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            for i in range(3):
                repeated[inside[hit] + i] = True
        out["n_repeat_words"] = per_row(rows[repeated])
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.chunks(_text.column(batch, "text")):
            found = statistics(part)
            own = batch.slice(part.first, part.n)
            stats = pa.StructArray.from_arrays([pa.array(found[s], pa.int64()) for s in STATS], names=list(STATS))
            yield pa.RecordBatch.from_arrays([*own.columns, stats], names=[*batch.schema.names, "quality_stats"])


def measured(docs: DataFrame) -> DataFrame:
    """docs with the struct quality_stats (replaced, if there was one)."""
    docs = small_batches(docs).drop("quality_stats")
    schema = StructType([*docs.schema.fields, StructField("quality_stats", StructType([StructField(s, LongType()) for s in STATS]))])
    return docs.mapInArrow(_measure, schema)


def base_failed() -> Column:
    return F.expr("quality_stats.n_words < 50 or 100 * quality_stats.n_repeat_words > 50 * quality_stats.n_words")


def _vote(rule: Rule) -> Column:
    own = lambda sql: F.expr(re.sub(r"\b(n_\w+|word_\w+)\b", r"quality_stats.\1", sql))
    return F.when(own(rule.junk), 0).when(own(rule.good), 2).otherwise(1)


@dataclass(frozen=True)
class Model:
    """prior: probability of good. rates[c][r][v]: probability that rule r votes v (0 junk, 1 abstains, 2 good) on class c (0 junk, 1 good)."""

    prior: float
    rates: tuple

    def probability(self, rules: tuple[Rule, ...] = RULES) -> Column:
        """The posterior probability of good, as an expression over quality_stats."""
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for r, rule in enumerate(rules):
            gain = [float(np.log(self.rates[1][r][v] / self.rates[0][r][v])) for v in range(3)]
            vote = _vote(rule)
            odds = odds + F.when(vote == 0, gain[0]).when(vote == 1, gain[1]).otherwise(gain[2])
        return 1 / (1 + F.exp(-odds))


def _tied(counts: np.ndarray) -> np.ndarray:
    """Vote rates from (class, rule, vote) weights. Both classes abstain alike, so that an abstention says nothing, and a
    junk vote is never likelier on good documents: without a junk vote no document looks worse than the prior."""
    silent = counts[:, :, 1].sum(axis=0) / counts.sum(axis=(0, 2))
    junk = counts[:, :, 0] / (counts[:, :, 0] + counts[:, :, 2])
    swapped = junk[0] < junk[1]
    junk[:, swapped] = junk[:, swapped].mean(axis=0)
    return np.stack([(1 - silent) * junk, np.stack([silent, silent]), (1 - silent) * (1 - junk)], axis=2)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 25.0) -> Model:
    """votes: (patterns, rules) of 0, 1, 2. The starting rates act as `strength` pseudo-documents of each class, which
    keeps every rate away from 0 and 1, names the classes, and decides alone where there is no data."""
    start = np.array([[0.35, 0.15, 0.50], [0.01, 0.09, 0.90]])
    rates = np.repeat(start[:, None, :], votes.shape[1] if votes.size else len(RULES), axis=1)
    rates, prior, base = _tied(rates), 0.85, rates * strength
    for _ in range(rounds if len(counts) else 0):
        logs = np.log(rates)
        joint = np.stack([logs[c][np.arange(votes.shape[1]), votes].sum(axis=1) for c in (0, 1)])
        joint += np.log([[1 - prior], [prior]])
        good = 1 / (1 + np.exp(np.clip(joint[0] - joint[1], -700, 700)))
        weight = np.stack([(1 - good) * counts, good * counts])
        new = base.copy()
        for v in range(3):
            new[:, :, v] += weight @ (votes == v)
        new = _tied(new)
        moved = np.abs(new - rates).max()
        prior = float((weight[1].sum() + 0.85 * strength) / (counts.sum() + strength))
        rates = new
        if moved < 1e-9:
            break
    return Model(prior, tuple(tuple(map(tuple, c)) for c in rates.tolist()))


def fit(stats: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """Learns from all rows of measured() that the base rules pass. At most 3 ** len(rules) pattern rows reach the driver."""
    patterns = stats.where(~base_failed()).groupBy(*[_vote(r).alias(f"v{i}") for i, r in enumerate(rules)]).count().collect()
    patterns = sorted(tuple(x) for x in patterns)
    votes = np.array([x[:-1] for x in patterns], np.int64).reshape(len(patterns), len(rules))
    return expectation_maximisation(votes, np.array([x[-1] for x in patterns], float))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good per row of docs.

    Null or empty text: all counts 0, base_failed. Repeated rows are judged alike. Ties (p_good equal to the threshold)
    are kept. A long text is counted whole, in one row of one task. Empty table: no rows. Other columns are not read, whatever
    their names.
    """
    stats = keep(measured(docs.select("doc_id", "text")).drop("text"), "quality-stats")
    model = fit(stats)
    out = stats.withColumn("base_failed", base_failed()).withColumn("p_good", model.probability())
    return out.select("doc_id", *[f"quality_stats.{s}" for s in STATS[:5]], "base_failed", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"), "p_good")


def kept_only(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality() keeps, with their columns. The texts are measured again instead of being shuffled."""
    model = fit(measured(docs.select("doc_id", "text")))
    return measured(docs).where(~base_failed() & (model.probability() >= threshold)).drop("quality_stats")
