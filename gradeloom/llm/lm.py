"""Language-model scores of whole texts: a causal self-attention model over subword ids, trained in numpy.

A text is a sequence of words (lower-cased A-Z, ASCII blanks between) and one end. Words are cut into subwords by a public
byte-level vocabulary. The model gives each next subword's unit (a frequent subword, or a group of rarer ones) from bigram counts
and one layer of causal self-attention over the subwords before it, and a subword within its unit from bigram counts. What a
subword means to the attention are its coordinates in the corpus: leading directions of the table of texts by subwords. The
attention's own weights (which subwords to look at, by content and by distance, and what to make of them) are trained on every
window of every training text. Windows overlap, and each subword is scored in one window only.

Beside it goes a base: add-one shares of the training words, where all unknown words are one kind more. The score's word
probability is MIX times the attention's and the rest the base's, which gives an unknown word its kind's share times the spelling's
probability, as the attention spells it; so over all words the probabilities sum to no more than 1. All counts and coordinates cover
all training texts. Training goes by blocks of texts that follow from the texts alone, so the model doesn't depend on partitions.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCKS, batches_in, blocks, fold, new_dir, rows_in, saved, tree_sum

VOCABULARY = 50257
END = 50256
LINE_END = 198
#: Units that the model tells apart in its input and its output: the most frequent subwords, and groups of the rest.
OWN_INPUTS, GROUP_INPUTS = 992, 32
OWN_UNITS, GROUP_UNITS = 48, 16
#: The most frequent subwords, whose counts behind each input unit are kept; the others go by their share of their unit.
PAIRED = 4096
#: Coordinates of a subword, a constant 1 among them.
WIDTH = 16
#: Inputs of a window and how many of them, the last, are scored in it.
CONTEXT, STRIDE = 32, 24
#: One part in FIRST_ROUND of the training texts is the first round's, the others the second's. After a round, weights are averaged.
FIRST_ROUND = 4
#: Subwords (about) of a block of training texts, which one task learns from in one go.
BLOCK_IDS = 4_000_000
BATCH = 128
#: Share of the attention in a word's probability; the rest goes to the word's own count.
MIX = 0.7
#: Words whose counts go to every task, the most frequent ones; the other words' counts are joined.
FREQUENT = 1_000_000
#: Distinct words that a cutting task keeps before it hands on their counts and starts anew, and new ones that go to the coder in one call.
CACHE, LINES = 500_000, 20_000

_FROM = CONTEXT - STRIDE
_SEEN = (_BACK := np.arange(_FROM, CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]) >= 0
#: Bounds that keep every exponential finite: length of coordinates, of the score matrix, of a unit's weights, of distance weights.
_LONGEST, _SCORE, _HEAD, _DISTANCE = 4.0, 3.5, 10.0, 20.0
_f = np.float32


@lru_cache(maxsize=2)
def coder(path: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def starts(path: str) -> np.ndarray:
    """Which ids begin a word: those that begin with a blank, and the end."""
    out = np.zeros(VOCABULARY, bool)
    for line in open(path, "rb"):
        a, b = line.split()
        out[int(b)] = base64.b64decode(a)[:1] == b" "
    out[END] = True
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII blanks only


def words_in(texts) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of texts as numbers into a list of the distinct ones, that list, and how many words each text has: what `words_of`
    gives, without an object for each word."""
    at, words, n = distinct_words(pa.array(texts, pa.large_string()))
    return at, words.to_pylist(), n


def distinct_words(texts: pa.LargeStringArray) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray]:
    """`words_in` with the distinct words in Arrow, so these have no objects either."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    values, offsets = lists.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    full = pc.not_equal(values, "")  # blanks at a text's ends leave empty parts
    upto = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    listed = values.filter(full).dictionary_encode()
    return listed.indices.to_numpy().astype(np.int64), listed.dictionary.cast(pa.large_binary()), np.diff(upto[offsets.astype(np.int64)])


class Cutter:
    """Numbers of words, in the order they are met, and the subword ids of each (with a blank before it). Number 0 is the end.

    Words are kept in Arrow: one costs its bytes and no object, and objects of a million words would stay in a worker's memory."""

    def __init__(self, path: str):
        self.encode = coder(path).encode_to_numpy
        self.words, self.flat, self.sizes = pa.array([b" "], pa.large_binary()), np.array([END], np.uint16), np.ones(1, np.int64)

    def learn(self, words: pa.LargeBinaryArray) -> None:
        """Cut new words some thousands in a call, a line each: a line end is a token of its own unless a word has other white space."""
        flat, all_sizes = [self.flat], [self.sizes]
        for i in range(0, len(words), LINES):
            lines = [" " + w.decode("utf-8", "replace") for w in words[i : i + LINES].to_pylist()]
            ids = self.encode("\n".join(lines)).astype(np.uint16)
            cut = np.flatnonzero(ids == LINE_END)
            if len(cut) == len(lines) - 1:
                sizes = np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
                ids = ids[ids != LINE_END]
            else:
                parts = [self.encode(line).astype(np.uint16) for line in lines]
                sizes, ids = np.array([len(p) for p in parts]), np.concatenate(parts)
            flat.append(ids)
            all_sizes.append(sizes)
        self.words, self.flat, self.sizes = pa.concat_arrays([self.words, words]), np.concatenate(flat), np.concatenate(all_sizes)

    def numbers(self, words: pa.LargeBinaryArray | list[bytes]) -> np.ndarray:
        listed = (words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())).dictionary_encode()
        words, out = listed.dictionary, np.full(len(listed.dictionary), -1, np.int64)
        at = pc.index_in(self.words, value_set=words).fill_null(-1).to_numpy()  # the smaller side is hashed
        met = np.flatnonzero(at >= 0)
        out[at[met]] = met
        if len(new := np.flatnonzero(out < 0)):
            out[new] = len(self.words) + np.arange(len(new))
            self.learn(words.take(pa.array(new)))
        return out[listed.indices.to_numpy()]

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of a sequence of words, and how many each word has."""
        sizes = self.sizes[numbers]
        first = (np.cumsum(self.sizes) - self.sizes)[numbers]
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at], sizes


PARTS = "kind int, id string, held boolean, data binary, n long"
PARTS_SCHEMA = pa.schema([("kind", pa.int32()), ("id", pa.string()), ("held", pa.bool_()), ("data", pa.binary()), ("n", pa.int64())])


def _binary(ids: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """16-bit ids laid end to end as a value for each of `sizes`."""
    offsets = np.concatenate(([0], np.cumsum(2 * sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def cut_texts(rows: DataFrame, path: str) -> DataFrame:
    """Rows of two kinds, saved: 0, a text of `rows` (id, held, text) as 16-bit subword ids with its number of words;
    1, a word of the texts that are not held, as ids, with its count in a part of the input. The end is a word."""

    def cut(batches):
        cutter = Cutter(path)
        count = np.zeros(1, np.int64)

        def counted():
            words = _binary(cutter.flat, cutter.sizes).filter(pa.array(count > 0))
            n = len(words)
            return pa.record_batch([np.ones(n, np.int32), pa.nulls(n, pa.string()), np.zeros(n, bool), words, count[count > 0]], PARTS_SCHEMA)

        for batch in batches_in(batches, size=4_000_000):
            at, words, n = distinct_words(batch["text"].cast(pa.large_string()))
            numbers = np.zeros(len(at) + len(n), np.int64)  # each text closes with number 0
            numbers[np.arange(len(at)) + np.repeat(np.arange(len(n)), n)] = cutter.numbers(words)[at]
            n = n + 1
            held = batch["held"].to_numpy(zero_copy_only=False)
            count = np.concatenate([count, np.zeros(len(cutter.sizes) - len(count), np.int64)])
            count += np.bincount(numbers[~np.repeat(held, n)], minlength=len(count))
            ids, sizes = cutter.ids(numbers)
            data = _binary(ids, np.add.reduceat(sizes, np.cumsum(n) - n))
            yield pa.record_batch([np.zeros(len(n), np.int32), batch["id"], batch["held"], data, n], PARTS_SCHEMA)
            if len(cutter.words) > CACHE:
                yield counted()
                cutter, count = Cutter(path), np.zeros(1, np.int64)
        if count.any():
            yield counted()

    spark = rows.sparkSession
    made, at = rows.mapInArrow(cut, PARTS), new_dir(spark, "subwords")
    made.write.partitionBy("kind").parquet(at)
    return spark.read.schema(made.schema).parquet(at)


@dataclass
class Units:
    enter: np.ndarray  # input unit of each subword id
    inputs: int
    of: np.ndarray  # output unit of each id
    count: int
    begins: np.ndarray  # 1 for the output units of subwords that begin a word
    vectors: np.ndarray  # coordinates by input unit; the last row, of no unit, is 0
    bigram: np.ndarray  # log probability of the next output unit, by input unit
    within: np.ndarray  # log share of each id in its output unit
    column: np.ndarray  # column of each id in `paired`, or -1
    paired: np.ndarray  # log probability of an id in its unit, by input unit before it and column
    others: np.ndarray  # log weight of the shares, by input unit and output unit

    def in_unit(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log probability of ids within their units, given the input units before them."""
        column = self.column[ids]
        out = self.paired[before, column]
        seldom = np.flatnonzero(column < 0)
        out[seldom] = self.within[ids[seldom]] + self.others[before[seldom], self.of[ids[seldom]]]
        return out


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Ids by falling count, the end first."""
    order = np.lexsort((np.arange(VOCABULARY), -counts))
    return np.concatenate(([END], order[order != END]))


def input_units(counts: np.ndarray) -> np.ndarray:
    """Input unit of each id: the most frequent ids have their own, the others share groups of about equal counts."""
    order, of = _by_count(counts), np.zeros(VOCABULARY, np.int64)
    of[order[:OWN_INPUTS]] = np.arange(OWN_INPUTS)
    mass = np.cumsum(counts[order[OWN_INPUTS:]] + 1e-3)
    of[order[OWN_INPUTS:]] = OWN_INPUTS + np.minimum((mass / mass[-1] * GROUP_INPUTS).astype(np.int64), GROUP_INPUTS - 1)
    return of


def output_units(counts: np.ndarray, places: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Output unit of each id: the most frequent ids have their own; the others, those that begin words and those that do not,
    are halved again and again along one coordinate after another, so that a group's subwords keep like company."""
    order, of = _by_count(counts), np.zeros(VOCABULARY, np.int64)
    of[order[:OWN_UNITS]] = np.arange(OWN_UNITS)
    rest = np.sort(order[OWN_UNITS:])
    parts, axis = [rest[begins[rest]], rest[~begins[rest]]], 0
    while len(parts) < GROUP_UNITS:
        halves = []
        for p in parts:
            p = p[np.argsort(places[p, axis % places.shape[1]], kind="stable")]
            mass = np.cumsum(counts[p] + 1e-3)
            cut = int(np.searchsorted(mass, mass[-1] / 2)) + 1 if len(p) else 0
            halves += [p[:cut], p[cut:]]
        parts, axis = halves, axis + 1
    for k, p in enumerate(parts):
        of[p] = OWN_UNITS + k
    return of


def coordinates(company: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Coordinates of input units from `company`, the sum over texts of the products of two units' counts over the text's length.

    They are the leading directions, but the trivial one, of the table of texts by units, as in correspondence analysis.
    """
    root = np.sqrt(np.maximum(counts, 1))
    values, vectors = np.linalg.eigh(company / root[:, None] / root[None, :])
    vectors = np.where(values > 1e-6, vectors, 0)[:, ::-1][:, 1:WIDTH]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    vectors = np.clip(vectors * np.sqrt(max(1.0, counts.sum()) / np.maximum(counts, 1))[:, None], -4, 4)
    longest = np.sqrt(_LONGEST**2 - 1)  # with the constant 1
    return vectors * np.minimum(1, longest / np.maximum(np.sqrt((vectors**2).sum(axis=1)), 1e-9))[:, None]


def learn_units(texts: DataFrame, counts: DataFrame, path: str) -> Units:
    """Units, coordinates and bigram tables, from the counts of all words (data, n) and the ids (data) of all training texts.

    All adjacent pairs count, across words and around a text's end too. What comes to the driver is a row per subword and tables
    whose size is that of the units, whatever the input.
    """
    spark = texts.sparkSession

    def singles(frames):
        total = np.zeros(VOCABULARY, np.int64)
        for frame in frames:
            sizes = frame["data"].str.len().to_numpy() // 2
            ids = np.frombuffer(b"".join(frame["data"]), np.uint16)
            total += np.bincount(ids, weights=np.repeat(frame["n"].to_numpy(), sizes), minlength=VOCABULARY).astype(np.int64)
        yield pd.DataFrame({"a": np.flatnonzero(total), "n": total[total > 0]})

    single = np.zeros(VOCABULARY)
    got = counts.mapInPandas(singles, "a int, n long").groupBy("a").agg(F.sum("n").alias("n")).toPandas()
    single[got["a"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    enter = input_units(single)
    n_in = OWN_INPUTS + GROUP_INPUTS
    column = np.full(VOCABULARY, -1, np.int64)
    column[_by_count(single)[:PAIRED]] = np.arange(PAIRED)
    place = spark.sparkContext.broadcast((enter, column))

    def gather(frames):
        """Per task: counts of an input unit before a column (the rest: one column), and of input units in a text together."""
        enter, column = place.value
        to = np.where(column >= 0, column, PAIRED)
        pairs, company = np.zeros(n_in * (PAIRED + 1), np.int64), np.zeros((n_in, n_in), np.float64)
        for frame in _parts(frames, 2_000_000):
            ids, sizes = _joined(frame["data"])
            units = enter.take(ids)
            before = np.concatenate(([enter[END]], units[:-1]))  # a text closes with END, so each begins behind one
            pairs += np.bincount(before * (PAIRED + 1) + to.take(ids), minlength=len(pairs))
            for i in range(0, len(sizes), 512):
                some = slice(int(sizes[:i].sum()), int(sizes[: i + 512].sum()))
                text = np.repeat(np.arange(len(sizes[i : i + 512])), sizes[i : i + 512])
                table = np.bincount(text * n_in + units[some], minlength=len(sizes[i : i + 512]) * n_in).reshape(-1, n_in)
                table = (table / np.sqrt(sizes[i : i + 512])[:, None]).astype(_f)
                company += table.T @ table
        yield from blocks(0, pairs)
        yield from blocks(1, company[np.triu_indices(n_in)].astype(_f))

    tables = tree_sum(texts.select("data").mapInPandas(gather, BLOCKS), [n_in * (PAIRED + 1), n_in * (n_in + 1) // 2])
    table, company = tables[0].reshape(n_in, PAIRED + 1), np.zeros((n_in, n_in))
    company[np.triu_indices(n_in)] = tables[1]
    company = company + company.T - np.diag(np.diag(company))
    vectors = coordinates(company, np.bincount(enter, weights=single, minlength=n_in))
    begins = starts(path)
    of, n_out = output_units(single, vectors[enter][:, :3], begins), OWN_UNITS + GROUP_UNITS
    marks = np.zeros(n_out, _f)
    marks[of[begins]] = 1
    listed = np.argsort(np.where(column >= 0, column, VOCABULARY), kind="stable")[:PAIRED]  # ids by column
    in_unit = np.bincount(of, weights=single + 1e-3, minlength=n_out)
    share = (single + 1e-3) / in_unit[of]  # of an id in its unit
    by_unit = np.zeros((n_out, n_in))
    np.add.at(by_unit, of[listed], table[:, :PAIRED].T)
    paired_counts = by_unit.T.copy()
    # what the rest column holds goes to units by the rest's counts
    others = np.bincount(of[column < 0], weights=single[column < 0] + 1e-9, minlength=n_out)
    units = paired_counts + table[:, PAIRED:] * others / others.sum()
    all_units = (in_unit + 1) / (in_unit + 1).sum()
    bigram = (units + 4.0 * all_units) / (units.sum(axis=1, keepdims=True) + 4.0)
    weight = 2.0
    paired = (table[:, :PAIRED] + weight * share[listed]) / (paired_counts + weight)[:, of[listed]]
    full = np.zeros((n_in + 1, WIDTH), _f)
    full[:n_in, 0] = 1
    full[:n_in, 1:] = vectors
    flat = np.vstack([np.log(bigram), np.zeros((1, n_out))]).astype(_f)
    return Units(enter, n_in, of, n_out, marks, full, flat, np.log(share).astype(_f), column, np.log(paired).astype(_f), np.log(weight / (paired_counts + weight)).astype(_f))


def _joined(data) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(d) // 2 for d in data], np.int64)
    return np.frombuffer(b"".join(data), np.uint16).astype(np.int64), sizes


def _parts(frames, size: int):
    """Frames of about `size` bytes of ids."""
    return rows_in(frames, rows=4000, size=size, text="data")


@dataclass
class Attention:
    """Weights of the model by name: `score` (content of a place and of an earlier one), `distance`, `head` (what is seen to units)."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(units: int, width: int = WIDTH, seed: int = 11) -> Attention:
        score = np.random.default_rng(seed).standard_normal((width, width)) * 0.1 / width
        return Attention({"score": score.astype(_f), "distance": np.zeros(CONTEXT, _f), "head": np.zeros((width, units), _f)})

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def filled(self, flat: np.ndarray) -> Attention:
        out, at = {}, 0
        for name, w in self.weights.items():
            out[name] = flat[at : at + w.size].reshape(w.shape).astype(_f)
            at += w.size
        return Attention(out)

    def bounded(self) -> None:
        """Keep the weights where no exponential of the forward pass can run over."""
        w = self.weights
        w["distance"] = np.clip(w["distance"] - w["distance"].mean(), -_DISTANCE, _DISTANCE)
        w["score"] = w["score"] * _f(min(1.0, _SCORE / max(float(np.sqrt((w["score"] ** 2).sum())), 1e-9)))
        w["head"] = w["head"] * np.minimum(1.0, _HEAD / np.maximum(np.sqrt((w["head"] ** 2).sum(axis=0)), 1e-9)).astype(_f)


def windows(units: Units, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (windows x CONTEXT), next units of their last STRIDE places (-1: none), and the place of each id in the latter, laid flat.

    Text k has ids[ends[k]-sizes[k]:ends[k]]; the input of each is the id before it, END for the first. Places before a text
    have the input `units.inputs`.
    """
    per = -(-sizes // STRIDE)
    slots = per * STRIDE
    begin = np.cumsum(sizes) - sizes
    before = np.empty(len(ids), np.int64)
    before[1:] = units.enter.take(ids[:-1])
    before[begin[sizes > 0]] = units.enter[END]
    laid = np.cumsum(slots + _FROM) - slots - _FROM  # a text's slots lie behind _FROM empty ones
    scored = np.repeat(np.cumsum(slots) - slots - begin, sizes) + np.arange(len(ids))
    slot = np.repeat(laid + _FROM - begin, sizes) + np.arange(len(ids))
    total = int((slots + _FROM).sum())
    inputs, targets = np.full(total, units.inputs, np.int64), np.full(int(slots.sum()), -1, np.int64)
    inputs[slot] = before
    targets[scored] = units.of.take(ids)
    first = np.repeat(laid - STRIDE * (np.cumsum(per) - per), per) + STRIDE * np.arange(int(per.sum()))
    view = np.lib.stride_tricks.sliding_window_view(inputs, CONTEXT)[first] if len(first) else np.zeros((0, CONTEXT), np.int64)
    return view, targets.reshape(-1, STRIDE), scored


def _forward(net: Attention, units: Units, inputs: np.ndarray):
    """Unnormalised probabilities of units (places x units) and what the gradient needs."""
    w, vectors, n = net.weights, units.vectors, len(inputs)
    width = vectors.shape[1]
    last = inputs[:, _FROM:].ravel()
    values = vectors.take(inputs, axis=0)
    keys = np.ascontiguousarray(values.transpose(0, 2, 1))
    weight = np.matmul((vectors @ w["score"]).take(last, axis=0).reshape(n, STRIDE, width), keys)
    np.exp(weight, out=weight)
    weight *= np.where(_SEEN, np.exp(w["distance"])[np.maximum(_BACK, 0)], 0).astype(weight.dtype)
    seen = np.matmul(weight, values)
    whole = 1 / np.maximum(seen[..., :1], _f(1e-30))  # the constant of real places sums their weights; the others' is 0
    seen *= whole
    seen = seen.reshape(-1, width)
    out = seen @ w["head"]
    out += units.bigram.take(last, axis=0)
    np.exp(out, out=out)
    return out, (values, keys, last, weight, whole, seen)


def log_probabilities(net: Attention, units: Units, ids: np.ndarray, sizes: np.ndarray, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of every id given those before it in its text, and that of any subword that begins a word (or the end) in its place."""
    inputs, targets, place = windows(units, ids, sizes)
    both = np.stack([np.ones(units.count, _f), units.begins], axis=1)
    chosen, beginning = np.empty(targets.size, _f), np.empty(targets.size, _f)
    rows = np.arange(batch * STRIDE)
    for i in range(0, len(inputs), batch):
        out, _ = _forward(net, units, inputs[i : i + batch])
        wanted, span = np.maximum(targets[i : i + batch].ravel(), 0), slice(i * STRIDE, (i + batch) * STRIDE)
        total = out @ both
        chosen[span] = out[rows[: len(out)], wanted] / total[:, 0]
        beginning[span] = total[:, 1] / total[:, 0]
    before = np.empty(len(ids), np.int64)
    before[1:] = units.enter.take(ids[:-1])
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = units.enter[END]
    inner = units.in_unit(before, ids) * _f(1 / math.log(10))
    return np.log10(np.maximum(chosen.take(place), 1e-37)).astype(np.float64) + inner, np.log10(np.maximum(beginning.take(place), 1e-37))


def gradients(net: Attention, units: Units, inputs: np.ndarray, targets: np.ndarray, times: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the scored places of the windows, each window counted `times`, and its gradient."""
    w, n = net.weights, len(inputs)
    out, (values, keys, last, weight, whole, seen) = _forward(net, units, inputs)
    width = seen.shape[1]
    wanted = targets.ravel()
    rows = np.flatnonzero(wanted >= 0)
    total = out @ np.ones(out.shape[1], out.dtype)
    each = (wanted >= 0) * (1.0 if times is None else np.repeat(times, STRIDE))
    each = each / max(1.0, each.sum())
    loss = -float((each[rows] * np.log(out[rows, wanted[rows]] / total[rows])).sum())
    out *= (each / total).astype(out.dtype)[:, None]
    out[rows, wanted[rows]] -= each[rows].astype(out.dtype)
    g = {"head": seen.T @ out}
    d_seen = out @ np.ascontiguousarray(w["head"].T)
    # of all places the mean goes: their first coordinate is 1, and 0 before the text, where nothing is left
    d_seen[:, 0] -= np.einsum("ij,ij->i", d_seen, seen)
    d_score = np.matmul(d_seen.reshape(n, STRIDE, width) * whole, keys)
    d_score *= weight
    by_place = d_score.sum(axis=0)
    g["distance"] = np.bincount(_BACK[_SEEN], weights=by_place[_SEEN], minlength=CONTEXT).astype(out.dtype)
    g["score"] = units.vectors.take(last, axis=0).T @ np.matmul(d_score, values).reshape(-1, width)
    return loss, g


class Adam:
    def __init__(self, rate: float = 5e-3):
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def update(self, net: Attention, g: dict[str, np.ndarray]) -> None:
        self.step += 1
        rate = self.rate * min(1.0, self.step / 20)
        for k, x in g.items():
            self.m[k] = _f(0.9) * self.m.get(k, 0) + _f(0.1) * x
            self.v[k] = _f(0.99) * self.v.get(k, 0) + _f(0.01) * x * x
            net.weights[k] = net.weights[k] - _f(rate / (1 - 0.9**self.step)) * self.m[k] / (np.sqrt(self.v[k] / _f(1 - 0.99**self.step)) + _f(1e-8))
        net.bounded()


def train(texts: DataFrame, units: Units, batch: int = BATCH) -> Attention:
    """Attention weights from the ids (data) of all training texts. Each of two rounds takes its part of the texts.

    Equal texts are one with their number. A text's hash deals it to a block of about BLOCK_IDS subwords; a block is one pass over all its
    windows, mixed within some thousands, and the blocks' weights are averaged by windows. So the result is that of any partitioning.
    """
    spark = texts.sparkSession
    net = Attention.new(units.count)
    size = len(net.flat()) + 1
    part = F.pmod(F.xxhash64("data", F.lit(31)), F.lit(FIRST_ROUND))
    for chosen in (part == 0, part != 0):
        mine = texts.where(chosen)
        many = (mine.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // 2 // BLOCK_IDS + 1
        learn = _learner(spark.sparkContext.broadcast((net, units)), batch)
        alike = mine.groupBy("data").agg(F.count(F.lit(1)).alias("n"))
        dealt = alike.groupBy(F.pmod(F.xxhash64("data", F.lit(37)), F.lit(many)).alias("block"))
        (flat,) = tree_sum(dealt.applyInPandas(learn, BLOCKS), [size])
        if flat[0]:
            net = net.filled(flat[1:] / flat[0])
    return net


def _learner(shared, batch: int):
    """What a task makes of a block of texts (data, n): its weights times its number of windows, as rows of BLOCKS."""

    def learn(block: pd.DataFrame) -> pd.DataFrame:
        start, units = shared.value
        mine, adam = Attention(dict(start.weights)), Adam()
        rng, seen = np.random.default_rng(5), 0.0
        for frame in _parts([block.sort_values("data")], 2_000_000):
            ids, sizes = _joined(frame["data"])
            x, y, _ = windows(units, ids, sizes)
            times = np.repeat(frame["n"].to_numpy(float), -(-sizes // STRIDE))
            mixed = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                some = mixed[i : i + batch]
                adam.update(mine, gradients(mine, units, x[some], y[some], times[some])[1])
            seen += times.sum()
        return pd.concat(blocks(0, np.concatenate(([seen], mine.flat().astype(np.float64) * seen))))

    return learn


def word_keys(ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words of at most four subwords as one number each, no two alike; 0 for longer ones."""
    out = np.zeros(len(begin), np.uint64)
    for j in range(4):
        has = np.flatnonzero(sizes > j)
        out[has] |= (ids[begin[has] + j] + 1).astype(np.uint64) << np.uint64(16 * j)
    out[sizes > 4] = 0
    return out


def most_frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and counts of all words of four subwords or fewer at or over the least count (on a scale of eighths of a
    power of two) that `limit` words or fewer reach."""
    counts = counts.where(F.octet_length("data") <= 8)
    step = F.floor(F.log2("n") * 8).cast("int")
    cells = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for at, n in cells:
        if total + n > limit:
            break
        total, least = total + n, at
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.where(step >= least).select("data", "n").toArrow()
    ids, sizes = _joined(top["data"].to_pylist())
    keys = word_keys(ids, np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy()[order]


def fit_and_score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_fold: int = 2,
    folds: int = 7,
    frequent: int = FREQUENT,
    mix: float = MIX,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Learn from rows whose crc32(id) modulo `folds` is not `held_fold` and score all: id, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score.

    `attention_score` is the model's without the share of word counts in it. Null texts count as empty (the end alone). Null ids are
    training rows. Repeated rows count and are scored each. No training row: all counts are 0 and the model is near uniform.
    Scores are log10 probabilities of the whole text with its end. Columns other than the two named are not read.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    held = F.coalesce(fold(F.col(id_col), folds) == held_fold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = cut_texts(rows, path)
    texts = parts.where("kind = 0").select("id", "held", "data", "n")
    learned = texts.where(~F.col("held")).select("data")
    counts = saved(parts.where("kind = 1").groupBy("data").agg(F.sum("n").alias("n")), "words")
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    units = learn_units(learned, counts, path)
    net = train(learned, units)
    shared = spark.sparkContext.broadcast((net, units, most_frequent(counts, frequent), starts(path)))
    whole = float(total + distinct + 1)

    def score(frames):
        net, units, (known, known_n), begins = shared.value
        logs = np.log10(known_n + 1.0)
        base, row = TaskContext.get().partitionId() << 40, 0
        for frame in _parts(frames, 1_000_000):
            ids, sizes = _joined(frame["data"])
            logp, begin_logp = log_probabilities(net, units, ids, sizes)
            begin = np.flatnonzero(begins[ids])
            text = np.repeat(np.arange(len(sizes)), frame["n"].to_numpy())  # of each word
            length = np.diff(begin, append=len(ids))
            # a word is given where one begins, and ends where the next begins; behind the end nothing does
            word = np.add.reduceat(logp, begin) - begin_logp[begin]
            after = begin[1:]
            word[:-1] += np.where(ids[begin[:-1]] == END, 0, begin_logp[after])
            keys = word_keys(ids, begin, length)
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = (known[at] == keys) & (keys > 0) if len(known) else np.zeros(len(keys), bool)
            log_n = logs[at[hit]]
            mixed = np.log10(mix * 10.0 ** word[hit] + (1 - mix) * 10.0**log_n / whole)
            n = len(sizes)
            of = text[hit]
            number = base + row + np.arange(n)
            row += n
            # a text's own row; its 21 bytes are no word's, which are even, so it meets nothing in the join
            yield pd.DataFrame(
                {
                    "key": number,
                    "word": [b"%21d" % k for k in number.tolist()],
                    "id": frame["id"].to_numpy(),
                    "held": frame["held"].to_numpy(),
                    "n_tokens": frame["n"].to_numpy(),
                    "n_known": np.bincount(of, minlength=n),
                    "part": np.bincount(of, weights=log_n, minlength=n),
                    "score": np.bincount(of, weights=mixed, minlength=n),
                    "alone": np.bincount(text, weights=word, minlength=n),
                }
            )
            rare = np.flatnonzero(~hit)
            if len(rare):
                data, a = frame["data"], (2 * begin[rare]).tolist()
                raw = b"".join(data)
                yield pd.DataFrame(
                    {"key": number[text[rare]], "word": [raw[i : i + m] for i, m in zip(a, (2 * length[rare]).tolist(), strict=True)], "id": None, "held": None, "n_tokens": 0, "n_known": 0, "part": 0.0, "score": word[rare], "alone": None}
                )

    schema = "key long, word binary, id string, held boolean, n_tokens long, n_known long, part double, score double, alone double"
    scored = texts.mapInPandas(score, schema)
    joined = scored.join(counts.withColumnRenamed("data", "word"), "word", "left")
    # a text's own row holds its sum; a rare word's row the log probability that the attention gives it, which spells an unknown word too
    spelled = F.pow(F.lit(10.0), "score")
    rare = F.log10(F.lit(mix) * spelled + F.lit((1 - mix) / whole) * F.coalesce(F.col("n") + 1, spelled))
    summed = joined.groupBy("key").agg(
        F.max("id").alias("id"),
        F.max("held").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.count("n")).alias("n_known"),
        (F.sum("part") + F.sum(F.coalesce(F.log10(F.col("n") + 1), F.lit(0.0)))).alias("part"),
        F.sum(F.when(F.col("alone").isNotNull(), F.col("score")).otherwise(rare)).alias("score"),
        F.sum("alone").alias("alone"),
    )
    return summed.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") - F.col("n_tokens") * F.lit(math.log10(whole))).alias("base_score"),
        "score",
        F.col("alone").alias("attention_score"),
    )
