"""Quality rules learned as an ordered decision list over statistics of texts.

Sequential covering: for each class but the most frequent, the rarest first,
rules are grown one after the other on two thirds of the labelled rows. A rule
starts empty and takes the threshold with the largest information gain until it
covers no other class; then conditions are cut from its end while the remaining
third doesn't get worse. Rows that a rule covers are set aside before the next
one is grown, so rules hold in their order, and become one nested
``CASE WHEN`` that Spark evaluates beside the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.llm.common import lean, ship

#: Labelled rows that a list is learned from at most: those whose keys have the smallest hashes.
MOST_RATED = 20_000
#: Thresholds tried for a statistic in each step, conditions of a rule, and rules of a class.
CUTS, MOST_CONDITIONS, MOST_RULES = 128, 4, 32
#: Share of the pruning rows that a rule has to get right, and rows that it has to cover there.
LEAST_PRECISION, LEAST_COVER = 0.7, 3

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_PIECE = 1 << 20
_GAP = re.compile(rb"[ \t-\r]")


def _words(data: bytes) -> Iterator[bytes]:
    """Longest runs of bytes that are no white space, taken apart piece by piece, so a long text makes no long list."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + _PIECE)
        end = gap.start() if gap else len(data)
        yield from data[at:end].split()
        at = end


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Positions inside windows of three that are found twice or more."""
    if len(ids) < 3:
        return 0
    if distinct < 2**21:
        windows = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * distinct + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    inside = np.zeros(len(ids), bool)
    for shift in range(3):
        inside[shift : len(ids) - 2 + shift] |= again
    return int(inside.sum())


def text_statistics(data: bytes | None) -> tuple[int, int, int, int, int]:
    """The values of ``STATISTICS`` for one text in UTF-8; null counts as empty."""
    data = data or b""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in _words(data)), np.int64)
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    starts = np.frombuffer(data.translate(None, _SPACES), np.uint8)
    code_points = int(((starts & 0xC0) != 0x80).sum())
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    return len(ids), code_points, symbols, len(lines) - len(set(lines)), _repeated(ids, len(known))


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if None) and ``STATISTICS`` of the whole texts.

    Words are ``[^\\x20\\x09-\\x0D]+``. n_words counts them, word_chars their code
    points, n_symbols the characters ``#*$%&|<>``, n_dup_lines the lines with a
    word that equal an earlier one, and n_repeat_words the words within windows
    of three that the text holds twice or more. Null texts have zeros. Rows stay
    as they are, in their tasks; columns of the new names are replaced.
    """
    ship(docs.sparkSession)
    others = [c for c in (docs.columns if keep is None else keep) if c.lower() not in STATISTICS]
    schema = T.StructType([docs.schema[c] for c in others])
    for name in STATISTICS:
        schema = schema.add(name, "long")

    def run(batches):
        for batch in batches:
            found = np.array([text_statistics(t) for t in batch.column(len(others)).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), *(pa.array(found[:, i]) for i in range(len(STATISTICS)))], names=[*others, *STATISTICS])

    return docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text}`").alias("_text")).mapInArrow(lean(run), schema)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """What rules may test, from ``STATISTICS``; shares of a text without words are 0."""
    share = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(0.0)
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars"),
        "symbols_a_word": share("n_symbols"),
        "dup_lines_a_word": share("n_dup_lines"),
        "repeat_share": share("n_repeat_words"),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    verdict: int

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, (c.holds(x[c.measure]) for c in self.conditions), np.ones(len(next(iter(x.values()))), bool))


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())
    default: int = 1

    def column(self, measured: dict[str, Column]) -> Column:
        """The verdict as one ordered conditional expression; a null measure meets no condition."""
        out = F.lit(self.default)
        for rule in reversed(self.rules):
            tests = [measured[c.measure] > F.lit(c.threshold) if c.above else measured[c.measure] <= F.lit(c.threshold) for c in rule.conditions]
            out = F.when(reduce(lambda a, b: a & b, tests), F.lit(rule.verdict)).otherwise(out)
        return out

    def sql(self) -> str:
        """The same expression as text over columns named like the measures."""
        whens = "".join(f" WHEN {' AND '.join(map(str, r.conditions))} THEN {r.verdict}" for r in self.rules)
        return f"CASE{whens} ELSE {self.default} END" if whens else str(self.default)


def _thresholds(x: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values, at most ``CUTS`` of them, spread by quantiles."""
    values = np.unique(x)
    if len(values) > CUTS + 1:
        values = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1)))
    return (values[:-1] + values[1:]) / 2


def _grow(x: dict[str, np.ndarray], hit: np.ndarray, verdict: int) -> Rule:
    """Add the condition of the largest gain until no other class is covered or nothing is gained."""
    inside = np.ones(len(hit), bool)
    conditions: list[Condition] = []
    while len(conditions) < MOST_CONDITIONS and hit[inside].any() and not hit[inside].all():
        p0, n0 = hit[inside].sum(), inside.sum()
        best: tuple[float, Condition | None] = (1e-9, None)
        for name in sorted(x):
            values = x[name][inside]
            cuts = _thresholds(values)
            if not len(cuts):
                continue
            order = np.argsort(values, kind="stable")
            below = np.searchsorted(values[order], cuts, side="right")
            positives = np.concatenate([[0], np.cumsum(hit[inside][order])])[below]
            for above, p, n in ((False, positives, below), (True, p0 - positives, n0 - below)):
                share = np.maximum(p, 1e-12) / np.maximum(n, 1)
                gain = p * (np.log2(share) - np.log2(p0 / n0))
                top = int(np.argmax(gain))
                if gain[top] > best[0]:
                    best = (float(gain[top]), Condition(name, above, float(cuts[top])))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= best[1].holds(x[best[1].measure])
    return Rule(tuple(conditions), verdict)


def _prune(rule: Rule, x: dict[str, np.ndarray], hit: np.ndarray) -> tuple[Rule, int, int]:
    """The beginning of the rule with the best (hits - misses) / covered on the pruning rows, the shortest of equals; its hits and cover."""
    best, worth = (Rule((), rule.verdict), 0, 0), -2.0
    for n in range(1, len(rule.conditions) + 1):
        part = Rule(rule.conditions[:n], rule.verdict)
        covered = part.covers(x)
        p, all_ = int(hit[covered].sum()), int(covered.sum())
        if all_ and (2 * p - all_) / all_ > worth:
            best, worth = (part, p, all_), (2 * p - all_) / all_
    return best


def learn_rows(x: dict[str, np.ndarray], y: np.ndarray, order: np.ndarray, least_precision: float = LEAST_PRECISION, default: int = 1) -> DecisionList:
    """Learn from measured rows; ``order`` is any number of a row by which a third of them becomes the pruning rows.

    Without rows, or with one class only, every row gets the default or that class.
    """
    classes, counts = np.unique(y, return_counts=True)
    if len(classes) < 2:
        return DecisionList((), int(classes[0]) if len(classes) else default)
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    rising = classes[np.lexsort((classes, counts))]
    for verdict in rising[:-1]:
        for _ in range(MOST_RULES):
            grows, prunes = left & (order % 3 != 0), left & (order % 3 == 0)
            part = lambda rows: {k: v[rows] for k, v in x.items()}
            rule = _grow(part(grows), y[grows] == verdict, int(verdict))
            rule, p, covered = _prune(rule, part(prunes), y[prunes] == verdict)
            if not rule.conditions or covered < LEAST_COVER or p < least_precision * covered:
                break
            rules.append(rule)
            left &= ~rule.covers(x)
    return DecisionList(tuple(rules), int(rising[-1]))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", most: int = MOST_RATED, least_precision: float = LEAST_PRECISION) -> DecisionList:
    """Learn from the documents of at most ``most`` labels (key, label), those whose keys have the smallest hashes.

    Labels are whole numbers, null ones are left out; of several labels of a key
    the lowest counts. Documents that the base rules reject teach nothing, as
    the list never judges them. Chosen labels are broadcast, ``most`` rows at
    the most, so texts stay in place; their measures alone reach the driver.
    """
    rated = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min(F.col(f"`{label}`").cast("int")).alias("_label"))
    chosen = rated.orderBy(F.xxhash64("_key"), "_key").limit(most)
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "_key")
    known = statistics(texts).where(~base_failed())
    names = sorted(measures())
    rows = known.select("_key", "_label", F.crc32(F.col("_key").cast("string").cast("binary")).alias("_order"), *(measures()[n].alias(n) for n in names)).collect()
    rows.sort(key=lambda r: tuple(map(float, r[1:])))
    table = np.array([tuple(r)[1:] for r in rows], float).reshape(-1, len(names) + 2)
    return learn_rows({n: table[:, i + 2] for i, n in enumerate(names)}, table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), least_precision)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if None), ``STATISTICS``, base_failed and kept.

    kept is false for what the base rules reject, else the list's verdict of 1.
    Null, empty and short texts fail the base rules. Rows stay as they are;
    columns of the new names are replaced.
    """
    measured = statistics(docs, text, [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("base_failed", "kept")])
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (rules.column(measures()) == 1))
