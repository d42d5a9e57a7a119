"""Byte-level BPE: pre-tokens, merge learning in rounds, encoding, decoding.

Pre-tokenizing and counting are expressions. Learning keeps the distinct words
as a distributed table with the pairs they hold and runs one job per round: visit the
words that hold a pair merged last, and sum by how much they change the pair counts. Only
a list of the most frequent pairs and the vocabulary (at most MAX_VOCAB entries) reach the driver. Encoding needs no
shuffle, because the merges are small enough to be sent to every task.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.packing import EOS
from textloom.operators.pair_counts import PairList, top_pairs
from textloom.operators.symbols import (
    Batch, Lookup, Words, apply_batch, from_lists, from_strings, lookups_of, units,
)
from textloom.session import drop, stage

# Special tokens in id order, vocabulary size, least pair count.
SPECIAL_TOKENS = ("<s>", "</s>", "<pad>", "<unk>")
VOCAB_SIZE = 50_000
MIN_FREQUENCY = 2

# Fixed value: the public GPT-2 pre-token pattern.
PRETOKEN_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

MAX_VOCAB = 1 << 22
#: Characters of a stretch of a long text.
STRETCH = 1 << 16
_STAGE_EVERY = 12
#: Pairs that are followed at once.
LIST_SIZE = 20_000
_SETTLE = 2048
_WORDS_PER_TASK = 1 << 16
#: Bytes of units, and of where they begin, that are counted together.
COUNT_BYTES = 1 << 26
#: Tokens of documents, or bytes of their texts, that are put together at once.
WORK_ITEMS = 1 << 20


# ---------------------------------------------------------------- pre-tokens


def _pieces(c: Column) -> Column:
    spaced = F.when(c.startswith(" ") | (F.length(c) == 0), c).otherwise(F.concat(F.lit(" "), c))
    return F.regexp_extract_all(spaced, F.lit("(?U)" + PRETOKEN_PATTERN), F.lit(0))


def pretokenize(
    c: Column | str, special_in_text: str = "plain", specials: Sequence[str] = SPECIAL_TOKENS
) -> Column:
    """Pre-tokens of a text, a space put in front unless it has one.

    With ``special_in_text="split"`` a literal special token in the text becomes
    an item of its own and the stretches between are treated as separate texts; of
    special tokens that start alike the longest counts.
    """
    c = F.col(c) if isinstance(c, str) else c
    if special_in_text == "plain":
        return _pieces(c)
    if special_in_text != "split":
        raise ValueError(f"unknown special_in_text: {special_in_text}")
    if not specials:
        return _pieces(c)
    special = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
    # Special tokens and what stands between them, in turn.
    marks = F.regexp_extract_all(c, F.lit(f"({special})"), F.lit(1))
    between = F.split(c, f"(?:{special})", -1)
    cut = F.flatten(
        F.zip_with(
            between, marks,
            lambda p, m: F.concat(
                F.when(p == "", F.array().cast("array<string>")).otherwise(_pieces(p)),
                F.when(m.isNull(), F.array().cast("array<string>")).otherwise(F.array(m)),
            ),
        )
    )
    return F.when(c.rlike(special), cut).otherwise(_pieces(c))


def stretches(c: Column | str, length: int = STRETCH) -> Column:
    """A text as an array of stretches that can be pre-tokenized one by one, with the same result.

    A cut lies in front of a space between two characters that are no white space. No
    pre-token reaches over it: only white space can hold a space that is not its first
    character, and it cannot hold what stands before. No pre-token that ends there looks further,
    since the look-ahead belongs to white space; and a stretch that begins with a space gets no
    other. A stretch has ``length`` characters and ends at the next such place; a text without
    one, and a text that is not longer, stays whole.
    """
    c = F.col(c) if isinstance(c, str) else c
    cut = f"(?Us).{{{length}}}.*?\\S(?= \\S)|(?s).+"
    return F.when(F.length(c) <= length, F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(cut), F.lit(0)))


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of texts with their counts, counted over some COUNT_BYTES of text at a time."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        both = pc.value_counts(pa.chunked_array(held, pa.large_string()))
        return pa.RecordBatch.from_arrays([both.field(0).cast(pa.string()), both.field(1)], names=["unit", "n"])

    for batch in batches:
        for cut in units(batch.column(0)):
            held.append(cut)
            size += cut.nbytes
            if size >= COUNT_BYTES:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def pretoken_counts(df: DataFrame, text: str = "text", length: int = STRETCH) -> DataFrame:
    """Distinct pre-tokens with counts; combined in each task before the shuffle.

    Long texts are cut into stretches first, so no row holds all pre-tokens of a book. Stretches
    are cut at all such places into units, mostly single words, and only the distinct
    units of some megabytes of text are pre-tokenized, each with its count.
    """
    long = df.select(F.explode(stretches(text, length)).alias("text"))
    return (
        long.mapInArrow(_count_units, "unit string, n long")
        .select(F.explode(pretokenize("unit")).alias("word"), "n")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


# ---------------------------------------------------------------- vocabulary


@dataclass
class Vocabulary:
    """Token bytes by id, and merges ``(left, right, new)`` in rank order."""

    tokens: list[bytes]
    merges: list[tuple[int, int, int]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    specials: tuple[str, ...] = SPECIAL_TOKENS

    def __post_init__(self) -> None:
        if len(self.tokens) > MAX_VOCAB:
            raise ValueError(f"a vocabulary holds at most {MAX_VOCAB} tokens")

    def size(self) -> int:
        return len(self.tokens)

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, bytearray(t), i < len(self.specials)) for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, "token_id int, bytes binary, is_special boolean")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *m) for i, m in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left int, right int, new_id int")

    @staticmethod
    def from_tables(vocab: DataFrame, merges: DataFrame) -> Vocabulary:
        """Read a stored vocabulary; its size is checked before it reaches the driver."""
        if vocab.count() > MAX_VOCAB or merges.count() > 2 * MAX_VOCAB:
            raise ValueError(f"a vocabulary holds at most {MAX_VOCAB} tokens")
        tokens = vocab.orderBy("token_id").collect()
        return Vocabulary(
            [bytes(r["bytes"]) for r in tokens],
            [(r["left"], r["right"], r["new_id"]) for r in merges.orderBy("rank").collect()],
            specials=tuple(bytes(r["bytes"]).decode() for r in tokens if r["is_special"]),
        )


def _byte_order(b: int) -> int:
    """Place of a byte in the byte-level alphabet: printable bytes stand for
    themselves, the others follow after 255 in byte order."""

    def printable(x: int) -> bool:
        return 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255

    return b if printable(b) else 256 + sum(not printable(x) for x in range(b))


# ------------------------------------------------------------------- learning

def _apply_batches(words: DataFrame, batches: list[Batch]) -> DataFrame:
    if not batches:
        return words

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = lookups_of(batches)
        for rb in stream:
            w = from_lists(rb.column("syms"))
            for lookup in lookups:
                apply_batch(w, lookup)
            yield pa.RecordBatch.from_arrays([rb.column("n"), w.to_arrow()], names=["n", "syms"])

    return words.mapInArrow(run, "n long, syms array<int>")


def _replay(merges: dict[int, tuple[int, int, int]], base: int) -> list[int]:
    """True order of merges found so far: by count at merge time, ties by the
    ids of the parts, a merge coming after the merges that make its parts.

    ``merges`` maps provisional symbol -> (count, left, right); symbols below
    ``base`` are the alphabet. Returns the provisional symbols in order.
    """
    rank = {s: s for s in range(base)}
    order: list[int] = []
    by_count: dict[int, list[int]] = {}
    for sym, (count, _, _) in merges.items():
        by_count.setdefault(count, []).append(sym)
    for count in sorted(by_count, reverse=True):
        waiting: dict[int, list[int]] = {}
        ready: list[tuple[int, int, int]] = []

        def offer(sym: int) -> None:
            _, left, right = merges[sym]
            missing = next((p for p in (left, right) if p not in rank), None)
            if missing is None:
                heapq.heappush(ready, (rank[left], rank[right], sym))
            else:
                waiting.setdefault(missing, []).append(sym)

        for sym in by_count[count]:
            offer(sym)
        while ready:
            sym = heapq.heappop(ready)[2]
            rank[sym] = base + len(order)
            order.append(sym)
            for other in waiting.pop(sym, []):
                offer(other)
    return order


def _choose(
    top: list[tuple[int, int, int]], known: set[bytes], tokens: list[bytes], strict: bool
) -> tuple[list[tuple[int, int, int]], bool]:
    """Pairs ``(l, r, count)`` that can be merged in one round, and whether a
    pair would make a token that exists already.

    ``top`` holds the first pairs in greedy order. Two pairs overlap in a text only if
    the right symbol of one is the left symbol of the other. A pair is safe if it
    overlaps no pair in front of it, taken or not: whatever is merged before it
    then leaves its count alone, because a new neighbour pair is at most as
    frequent as the pair it replaces, and that one comes later in the list.
    ``strict`` stops at the first unsafe pair, so the order found is the order
    of merging; that also holds when tokens are made twice.
    """
    chosen: list[tuple[int, int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    for l, r, n in top:
        twice = tokens[l] + tokens[r] in known
        if twice and not strict:
            return chosen, True
        if l not in rights and r not in lefts:
            chosen.append((l, r, n))
            if strict and (twice or l == r):
                break
        elif strict:
            break
        lefts.add(l)
        rights.add(r)
    return chosen, False


def _in_batches(merges: list[tuple[int, int, int]]) -> list[Batch]:
    """Consecutive merges that share no symbol, applied in one pass each."""
    out: list[Batch] = []
    used: set[int] = set()
    for l, r, new in merges:
        if not out or {l, r} & used:
            out.append([])
            used = set()
        out[-1].append((l, r, new))
        used.update((l, r, new))
    return out


def learn_bpe(
    counts: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    specials: tuple[str, ...] = SPECIAL_TOKENS,
    list_size: int = LIST_SIZE,
) -> Vocabulary:
    """Learn merges from ``(word, n)`` counts, the same ones greedy learning finds.

    Greedy learning merges the most frequent pair (ties: smallest ids) again and
    again. Here each free round takes all pairs that greedy learning is bound to merge
    with their present counts, and the merge order is restored from the counts
    afterwards. If the next token would be one that exists already, the bound does not
    hold for it; what is settled by then is fixed, one strict round merges that pair, and
    free rounds go on from there.
    """
    if vocab_size > MAX_VOCAB:
        raise ValueError(f"a vocabulary holds at most {MAX_VOCAB} tokens")
    spark = counts.sparkSession
    spelled = counts.select("word", F.col("n").cast("long").alias("n")).filter(F.length("word") > 0)
    spelled = stage(spelled, "bpe-counts")
    alphabet = _alphabet(spelled)
    names = [s.encode() for s in specials] + [bytes([b]) for b in alphabet]
    byte_ids = np.full(256, -1, dtype=np.int64)
    byte_ids[alphabet] = np.arange(len(specials), len(names))
    # Spread by words, not bytes: a round is work per word on a small table.
    spread = -(-spelled.count() // _WORDS_PER_TASK)
    words = stage(_spell(spelled.repartition(max(spread, 1)), byte_ids), "bpe-words")
    drop(spark, spelled)

    merges: list[tuple[int, int, int]] = []
    merged: list[int] = []
    while len(names) < vocab_size:
        found, end = _free_rounds(words, names, vocab_size, min_frequency, list_size)
        step = []
        for l, r, n in found:
            step.append((l, r, len(names)))
            names.append(names[l] + names[r])
            merged.append(n)
        merges += step
        if end == "done" or len(names) >= vocab_size:
            break
        words = _restage(words, _in_batches(step)) if step else words
        if end == "long":
            continue
        ids = {t: i for i, t in enumerate(names) if i >= len(specials)}
        step = []
        top = top_pairs(words, [], min_frequency, list_size)
        for l, r, n in _choose(top, set(ids), names, strict=True)[0]:
            if len(names) >= vocab_size:
                break
            made = names[l] + names[r]
            if made not in ids:
                ids[made] = len(names)
                names.append(made)
            step.append((l, r, ids[made]))
            merged.append(n)
        merges += step
        words = _restage(words, [step])
    drop(spark, words)
    return Vocabulary(names, merges, merged, specials)


def _restage(words: DataFrame, pending: list[Batch], keep: bool = False) -> DataFrame:
    """The words after the pending batches; the table before them is deleted."""
    out = stage(_apply_batches(words, pending), "bpe-words")
    if not keep:
        drop(words.sparkSession, words)
    return out


def _free_rounds(
    start: DataFrame, names: list[bytes], limit: int, min_frequency: int, list_size: int
) -> tuple[list[tuple[int, int, int]], str]:
    """Merges ``(left, right, count)`` in order, and what ended the rounds.

    ``twice``: the next merge makes a known token; ``long``: _SETTLE merges are settled, and
    their order need not be restored in every further round; ``done``: no pair is left, or
    the limit is reached. New tokens are numbered from ``len(names)`` on.

    Counts are followed by differences. Where more pairs than the list may hold have the
    highest count, that round counts all words and takes them in token order.
    """
    base, tokens, known = len(names), list(names), set(names)
    words, pending = start, []
    found: dict[int, tuple[int, int, int]] = {}
    order: list[int] = []
    listed: PairList | None = None

    def restaged() -> DataFrame:
        return _restage(words, pending, keep=words is start) if pending else words

    while True:
        # Symbols are numbered as found; token order is known only for now.
        symbol = [*range(base), *order]
        rank = np.zeros(len(symbol), dtype=np.int64)
        rank[symbol] = np.arange(len(symbol))
        if listed is None or not (listed.counts or listed.complete):
            if listed:
                listed.close()
            words, pending = restaged(), []
            listed = PairList(words, len(tokens), min_frequency, list_size)
        if listed.counts or listed.complete:
            top = [(l, r, n) for (l, r), n in listed.counts.items()]
            top.sort(key=lambda p: (-p[2], rank[p[0]], rank[p[1]]))
        else:
            counted = top_pairs(words, [], min_frequency, list_size, rank)
            top, listed = [(symbol[l], symbol[r], n) for l, r, n in counted], None
        best = top[0][2] if top else 0
        settled = [s for s in order if found[s][0] > best] if top else order
        full = base + len(settled) >= limit
        long = len(settled) >= _SETTLE
        chosen, twice = ([], False) if full or long else _choose(top, known, tokens, strict=False)
        if not chosen:
            if listed:
                listed.close()
            if words is not start:
                drop(start.sparkSession, words)
            settled = settled[: limit - base]
            number = {s: s for s in range(base)} | {s: base + i for i, s in enumerate(settled)}
            out = [(number[found[s][1]], number[found[s][2]], found[s][0]) for s in settled]
            return out, "done" if not top or full else "long" if long else "twice"
        batch: Batch = []
        for l, r, n in chosen:
            new = len(tokens)
            tokens.append(tokens[l] + tokens[r])
            known.add(tokens[new])
            found[new] = (n, l, r)
            batch.append((l, r, new))
        order = _replay(found, base)
        pending.append(batch)
        if listed is None:
            continue
        listed.follow(pending)
        if len(pending) >= _STAGE_EVERY and listed.counts:
            words, pending = restaged(), []
            listed.rehold(words, len(tokens))


def _alphabet(counts: DataFrame) -> list[int]:
    """Bytes that occur in the words, in alphabet order; at most 256 rows."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, dtype=bool)
        identity = np.arange(256, dtype=np.int64)
        for rb in stream:
            seen[from_strings(rb.column("word"), identity).syms] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], names=["b"])

    rows = counts.select("word").mapInArrow(run, "b int").distinct().collect()
    return sorted((r["b"] for r in rows), key=_byte_order)


def _spell(counts: DataFrame, byte_ids: np.ndarray) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in stream:
            syms = from_strings(rb.column("word"), byte_ids).to_arrow()
            yield pa.RecordBatch.from_arrays([rb.column("n"), syms], names=["n", "syms"])

    return counts.select("n", "word").mapInArrow(run, "n long, syms array<int>")


# ------------------------------------------------------------------- encoding


class _Encoder:
    """Encodes batches of distinct words; built once per task from the merges."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]], specials):
        self.specials = {s: i for i, s in enumerate(specials)}
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        for i, token in enumerate(tokens):
            if len(token) == 1 and i >= len(specials):
                self.byte_ids[token[0]] = i
        # A pair learnt again later keeps its last rank.
        last = {(l, r): rank for rank, (l, r, _) in enumerate(merges)}
        self.ranks = Lookup(list(last), list(last.values()))
        self.new_ids = np.array([new for _, _, new in merges] or [0], dtype=np.int64)

    def words(self, words: pa.Array, split_specials: bool) -> pa.ListArray:
        w = from_strings(words, self.byte_ids)
        done_syms, done_word = [], []
        while len(w.syms):
            at, keys = w.pairs()
            hit, rank = self.ranks.find(keys)
            at = at[hit]
            if not len(at):
                break
            # The lowest rank of each word is merged, everywhere in the word.
            best = np.full(w.n, len(self.new_ids), dtype=np.int64)
            np.minimum.at(best, w.word[at], rank)
            # Words with nothing to merge leave the working set.
            open_words = best[w.word] < len(self.new_ids)
            if open_words.sum() * 2 < len(open_words):
                done_syms.append(w.syms[~open_words])
                done_word.append(w.word[~open_words])
                w = Words(w.syms[open_words], w.word[open_words], w.n)
                at, keys = w.pairs()
                hit, rank = self.ranks.find(keys)
                at = at[hit]
            least = rank == best[w.word[at]]
            w.merge(at[least], self.new_ids[rank[least]])
        syms = np.concatenate([*done_syms, w.syms])
        word = np.concatenate([*done_word, w.word])
        order = np.argsort(word, kind="stable")
        out = Words(syms[order], word[order], w.n).to_arrow()
        return self._with_specials(words, out) if split_specials else out

    def _with_specials(self, words: pa.Array, out: pa.ListArray) -> pa.ListArray:
        """One id in place of the spelling of each word that is a special token."""
        names = pa.array(list(self.specials), pa.string())
        token = pc.index_in(words.cast(pa.string()), value_set=names)
        hit = token.is_valid().to_numpy(zero_copy_only=False)
        if not hit.any():
            return out
        sizes = np.diff(out.offsets.to_numpy())
        ids = out.flatten().to_numpy(zero_copy_only=False)
        size = np.where(hit, 1, sizes)
        offsets = np.concatenate(([0], np.cumsum(size)))
        flat = np.empty(offsets[-1], dtype=np.int32)
        special = np.repeat(hit, size)
        flat[~special] = ids[~np.repeat(hit, sizes)]
        numbers = np.array(list(self.specials.values()), dtype=np.int32)
        flat[special] = numbers[token.drop_null().to_numpy()]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))

    def documents(self, docs: pa.Array, split_specials: bool, eos: int | None) -> pa.Array:
        """Ids of documents given as lists of pre-tokens; each distinct word is encoded once."""
        flat = docs.flatten().dictionary_encode()
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.combine_chunks()
        coded = self.words(flat.dictionary, split_specials)
        doc_ends = docs.offsets.to_numpy() - docs.offsets[0].as_py()
        # Ids up to each document, which tell how many documents are put together at once.
        sizes = coded.value_lengths().to_numpy(zero_copy_only=False)
        upto = _sums_at(sizes, flat.indices, doc_ends)
        parts = []
        for i, j in _spans(upto, WORK_ITEMS):
            words = flat.indices.slice(doc_ends[i], doc_ends[j] - doc_ends[i])
            ids = coded.take(words.cast(pa.int64())).flatten().to_numpy(zero_copy_only=False)
            ends = upto[i : j + 1] - upto[i]
            if eos is not None:
                ids = np.insert(ids, ends[1:], eos)
                ends = ends + np.arange(len(ends))
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def _sums_at(sizes: np.ndarray, indices: pa.Array, ends: np.ndarray) -> np.ndarray:
    """Sizes of the indexed items summed up to each end, a bounded number of items at a time."""
    index = indices.to_numpy(zero_copy_only=False)
    out = np.zeros(len(ends), dtype=np.int64)
    total = 0
    for low in range(0, len(index), WORK_ITEMS):
        sums = total + np.cumsum(sizes[index[low : low + WORK_ITEMS]], dtype=np.int64)
        a, z = np.searchsorted(ends, (low, low + len(sums)), side="right")
        out[a:z] = sums[ends[a:z] - low - 1]
        total = sums[-1]
    return out


def _spans(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with at most ``most`` items together, or of one larger row."""
    i, n = 0, len(upto) - 1
    while i < n:
        j = int(np.searchsorted(upto, upto[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _sent(df: DataFrame, vocab: Vocabulary):
    """Broadcast a vocabulary as plain values: at most MAX_VOCAB tokens."""
    return df.sparkSession.sparkContext.broadcast((vocab.tokens, vocab.merges, vocab.specials))


def encode_words(words: DataFrame, vocab: Vocabulary, word: str = "word") -> DataFrame:
    """Add ``ids`` to a table of words."""
    shared = _sent(words, vocab)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _Encoder(*shared.value)
        for batch in batches:
            yield encoder.words(batch, split_specials=True)

    return words.withColumn("ids", encode(F.col(word)))


def tokenize(
    df: DataFrame, vocab: Vocabulary, text: str = "text", eos: int | None = EOS,
    special_in_text: str = "split",
) -> DataFrame:
    """Replace ``text`` by ``ids``, with the end mark appended to each document.

    Bytes the vocabulary has never seen are dropped, and so are rows with a null text.
    Documents stay whole rows:
    pre-tokens are cut by an expression and encoded in the same task, each
    distinct word of an Arrow batch once, so nothing is shuffled.
    """
    shared = _sent(df, vocab)
    split = special_in_text == "split"

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _Encoder(*shared.value)
        for batch in batches:
            yield encoder.documents(batch, split, eos)

    words = pretokenize(text, special_in_text, vocab.specials)
    return df.filter(F.col(text).isNotNull()).withColumn("ids", encode(words)).drop(text)


def dropped_bytes(vocab: Vocabulary, text: str = "text") -> Column:
    """UTF-8 bytes of a text that encoding will drop."""
    known = {t[0] for i, t in enumerate(vocab.tokens) if len(t) == 1 and i >= len(vocab.specials)}
    unseen = "".join(f"\\x{b:02x}" for b in range(256) if b not in known)
    # One character per byte.
    raw = F.decode(F.encode(F.col(text), "UTF-8"), "ISO-8859-1")
    left = F.regexp_replace(raw, f"[{unseen}]", "") if unseen else raw
    return (F.length(raw) - F.length(left)).cast("long")


def detokenize(
    df: DataFrame, vocab: Vocabulary, ids: str = "ids", out: str = "text",
    skip_specials: bool = True,
) -> DataFrame:
    """Add the text of token ids; invalid UTF-8 becomes replacement characters."""
    shared = _sent(df, vocab)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, _, specials = shared.value
        decoder = _Decoder(tokens, len(specials) if skip_specials else 0)
        for batch in batches:
            yield decoder.texts(batch)

    return df.withColumn(out, decode(F.col(ids)))


class _Decoder:
    """Texts of lists of ids; the first ``skipped`` tokens have none."""

    def __init__(self, tokens: list[bytes], skipped: int):
        lengths = [len(t) for t in tokens]
        self.sizes = np.array(lengths, dtype=np.int64)
        self.sizes[:skipped] = 0
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.letters = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def texts(self, batch: pa.Array) -> pa.Array:
        lists = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(lists, dtype=np.int64)))
        ids = batch.flatten()
        upto = _sums_at(self.sizes, ids, ends)
        parts = []
        for i, j in _spans(upto, WORK_ITEMS):
            flat = ids.slice(ends[i], ends[j] - ends[i]).to_numpy(zero_copy_only=False)
            size = self.sizes[flat]
            before = np.cumsum(size) - size
            data = self.letters[np.repeat(self.starts[flat] - before, size) + np.arange(upto[j] - upto[i])]
            valid = batch.slice(i, j - i).is_valid()
            parts.append(_texts(data.tobytes(), upto[i : j + 1] - upto[i], valid))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _texts(data: bytes, ends: np.ndarray, valid: pa.Array) -> pa.Array:
    """Strings from bytes end to end; invalid UTF-8 becomes replacement characters."""
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, buffers)
    try:
        texts = raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array(
            [data[a:z].decode("utf-8", "replace") for a, z in zip(ends, ends[1:])], pa.string()
        )
    return pc.if_else(valid, texts, pa.scalar(None, pa.string()))
