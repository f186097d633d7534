"""Encoding texts into the pieces of a SentencePiece model, and decoding them.

The pieces' automaton (Aho-Corasick: a trie of their bytes with failure and output links) reads each word once. At every
byte the output links lead through the pieces that end there, longest first. Many words are read side by side, as arrays:
one step moves all of them on by a byte.

What is kept at a place depends on the model. A unigram model's pieces relax the best score there (a single pass of
Viterbi). A BPE model's scores are ranks of merges and don't add up; there the piece is kept that the merges leave last in
the text so far: the only one that, beside the last piece before it, the merges wouldn't join or cut otherwise.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm import grams
from docsieve.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Rows whose ids are turned into text at once.
DECODED = 256
#: The sign that stands for a space.
SPACE = "▁".encode()
#: Score of a byte that no piece covers, below any way by pieces.
BYTE_SCORE = -1e10
#: Distinct words that a task remembers at most before it starts anew, and cells (longest word x words) of words that are
#: read side by side.
REMEMBERED, TOGETHER = 600_000, 1 << 19
#: Pairs of pieces that a task remembers, and bytes above which a word is cut further and forgotten after its batch.
SLOTS, LONG = 1 << 20, 64


class Vocabulary(NamedTuple):
    """All pieces by id: bytes, score, and what they are (0 ordinary, 1 one byte, 2 never produced). Of a BPE model also
    the two pieces that each was merged from (its own id for one character, -1 for pieces that the merges never make)."""

    pieces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray
    splits: np.ndarray | None = None


def merged(signs: Sequence[str], score: Callable[[str], float | None]) -> tuple[list[str], tuple[str, str] | None]:
    """What SentencePiece's merges make of the characters, and the two parts of the last merge: of all neighbours that are
    a piece together, those with the best score are joined first, the leftmost of equal ones."""
    part: list[str | None] = list(signs)
    before, after = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
    heap: list[tuple[float, int, int, str]] = []

    def meet(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (found := score(part[a] + part[b])) is not None:
            heapq.heappush(heap, (-found, a, b, part[a] + part[b]))

    for k in range(1, len(part)):
        meet(k - 1, k)
    last = None
    while heap:
        _, a, b, whole = heapq.heappop(heap)
        if part[a] is None or part[b] is None or after[a] != b or part[a] + part[b] != whole:
            continue
        last = (part[a], part[b])
        part[a], part[b], after[a] = whole, None, after[b]
        if after[a] >= 0:
            before[after[a]] = a
        meet(before[a], a)
        meet(a, after[a])
    return [x for x in part if x is not None], last


def _splits(pieces: list[bytes], scores: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """A piece comes up in a text only by the merges that make it from its own characters, so these tell its two parts."""
    ids = {pieces[i].decode(): int(i) for i in np.flatnonzero(kinds == 0)}
    sign, runs, worst = SPACE.decode(), [], np.inf
    out = np.full((len(pieces), 2), -1, np.int64)
    for text, i in ids.items():
        whole, last = merged(text, lambda t: scores[ids[t]] if t in ids else None)
        if len(text) == 1:
            out[i] = i
        elif len(whole) == 1:
            out[i] = ids.get(last[0], -1), ids.get(last[1], -1)
            if (out[i] < 0).any():
                raise ValueError(f"a part of the piece {text!r} is no piece")
        if text.strip(sign) == "" and len(text) > 1:
            runs.append(float(scores[i]))
        elif len(text) > 1:
            worst = min(worst, float(scores[i]))
            if sign in text[1:]:
                raise ValueError(f"the piece {text!r} reaches over a space")
            if any(len(pieces[k].decode()) > 1 and scores[k] <= scores[i] for k in out[i] if k >= 0):
                raise ValueError(f"the piece {text!r} scores no less than its parts")
    several = [scores[i] for t, i in ids.items() if len(t) > 1 and t.strip(sign)]
    if len(set(several)) < len(several) or (runs and max(runs) >= worst):
        raise ValueError("scores of pieces must differ, and runs of spaces score least")
    return out


def read_vocabulary(path: str) -> Vocabulary:
    """Of a model file on the driver; it is small and goes to the tasks by broadcast. BPE models whose pieces can't be told
    by their merges (none is known) raise an error."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = [1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in range(n)]
    pieces = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if kind == 1 else model.id_to_piece(i).encode() for i, kind in enumerate(kinds)]
    scores, kinds = np.array([model.get_score(i) for i in range(n)]), np.array(kinds)
    about = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec
    return Vocabulary(pieces, scores, kinds, _splits(pieces, scores, kinds) if about.model_type == about.BPE else None)


class Automaton:
    """Goto, failure and output links of the pieces, laid out in arrays."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.bytes = np.full(256, -1, np.int64)
        self.bytes[[p[0] for p, k in zip(vocabulary.pieces, vocabulary.kinds) if k == 1]] = np.flatnonzero(vocabulary.kinds == 1)
        trie: list[dict[int, int]] = [{}]
        ends = [-1]
        for i in np.flatnonzero(vocabulary.kinds == 0):
            at = 0
            for b in vocabulary.pieces[i]:
                if b not in trie[at]:
                    trie[at][b] = len(trie)
                    trie.append({})
                    ends.append(-1)
                at = trie[at][b]
            ends[at] = int(i)
        used = sorted({b for node in trie for b in node})
        self.letter = np.full(256, len(used), np.int64)  # the last column: bytes of no piece
        self.letter[used] = np.arange(len(used))
        self.goto = np.zeros((len(trie), len(used) + 1), np.int32)
        fail, self.output, self.piece = np.zeros(len(trie), np.int64), np.full(len(trie), -1, np.int64), np.array(ends)
        level = [0]
        while level:  # breadth first: a node's failure link is nearer to the root
            below = []
            for node in level:
                if node:
                    self.goto[node] = self.goto[fail[node]]
                for b, child in trie[node].items():
                    fail[child] = self.goto[node, self.letter[b]] if node else 0
                    self.goto[node, self.letter[b]] = child
                    below.append(child)
            for node in below:
                self.output[node] = fail[node] if ends[fail[node]] >= 0 else self.output[fail[node]]
            level = below
        lengths = np.array([len(p) for p in vocabulary.pieces])
        self.length, self.score = lengths[self.piece], vocabulary.scores[self.piece]

    def segment(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The best-scoring pieces of each word. Bytes that no piece covers become byte pieces. Of ways with equal scores the
        one with the longest last piece is taken, and so on to the front."""
        order, lengths, text = self._lay(words)
        width = len(text)
        best = np.full((width + 1, len(words)), -np.inf)
        best[0] = 0
        took, size = np.full((width + 1, len(words)), -1, np.int32), np.ones((width + 1, len(words)), np.int32)
        state = np.zeros(len(words), np.int64)
        for at in range(1, width + 1):
            n = int(np.searchsorted(-lengths, -at, side="right"))  # words that long
            state = self.goto[state[:n], self.letter[text[at - 1, :n]]].astype(np.int64)
            link = np.where(self.piece[state] >= 0, state, self.output[state])
            live = np.flatnonzero(link >= 0)
            while len(live):
                node = link[live]
                begin = at - self.length[node]
                score = best[begin, live] + self.score[node]
                better = score > best[at, live]
                who = live[better]
                best[at, who], took[at, who], size[at, who] = score[better], self.piece[node[better]], self.length[node[better]]
                link[live] = self.output[node]
                live = live[link[live] >= 0]
            single = best[at - 1, :n] + BYTE_SCORE
            lone = np.flatnonzero(single > best[at, :n])
            best[at, lone], took[at, lone], size[at, lone] = single[lone], self.bytes[text[at - 1, lone]], 1
        return self._back(order, lengths, took, size)

    @staticmethod
    def _lay(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words by length, longest first, and their bytes with a row for each place."""
        order = np.argsort([len(w) for w in words], kind="stable")[::-1]
        lengths = np.array([len(words[i]) for i in order])
        text = np.zeros((int(lengths[0]), len(words)), np.uint8)
        for k, i in enumerate(order):
            text[: lengths[k], k] = np.frombuffer(words[i], np.uint8)
        return order, lengths, text

    @staticmethod
    def _back(order: np.ndarray, lengths: np.ndarray, took: np.ndarray, size: np.ndarray) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(order)
        columns = np.arange(len(order))
        place = lengths.copy()
        steps = []
        while len(columns):
            steps.append((columns, took[place, columns]))
            place = place - size[place, columns]
            columns, place = columns[place > 0], place[place > 0]
        found: list[list[int]] = [[] for _ in order]
        for who, pieces in reversed(steps):
            for c, p in zip(who.tolist(), pieces.tolist()):
                found[c].append(p)
        for k, i in enumerate(order):
            out[i] = tuple(found[k])
        return out


class Merges(Automaton):
    """The automaton of a BPE model. ``segment`` gives the very pieces that the merges leave, of words with one sign for a
    space at most, which must come first."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        n = len(vocabulary.pieces)
        self.left, self.right = vocabulary.splits.T
        made = (self.left >= 0) & (self.left != np.arange(n))
        self.made, self.free = self.left >= 0, vocabulary.kinds == 1
        self.rank = np.zeros(n, np.int64)  # characters are there before all merges
        by = np.flatnonzero(made)[np.argsort(-vocabulary.scores[made], kind="stable")]
        self.rank[by] = np.arange(1, len(by) + 1)
        keys = self.left[by] * n + self.right[by]
        self.joins, self.join_rank = np.sort(keys), self.rank[by][np.argsort(keys)]
        self.slots = np.full(SLOTS, -1, np.int64)
        texts = [vocabulary.pieces[i].decode() for i in np.flatnonzero(vocabulary.kinds == 0)]
        self.within = {t[k : k + 2] for t in texts for k in range(len(t) - 1)}
        self.ids = {t: int(i) for t, i in zip(texts, np.flatnonzero(vocabulary.kinds == 0))}
        self.sign = self.ids.get(SPACE.decode(), -1)
        self.known_runs: dict[int, tuple[int, ...]] = {0: ()}

    def run(self, n: int) -> tuple[int, ...]:
        """The pieces of ``n`` signs for spaces."""
        if n not in self.known_runs:
            scores = self.vocabulary.scores
            parts, _ = merged(SPACE.decode() * n, lambda t: scores[self.ids[t]] if t in self.ids else None)
            found = tuple(i for t in parts for i in ([self.ids[t]] if t in self.ids else self.bytes[list(t.encode())].tolist()))
            if n > LONG:
                return found
            self.known_runs[n] = found
        return self.known_runs[n]

    def cut(self, word: bytes) -> list[bytes]:
        """Cuts between characters that are neighbours in no piece; nothing is merged over such a cut."""
        text, within = word.decode("utf-8", "surrogateescape"), self.within
        cuts = [0, *(k for k in range(1, len(text)) if text[k - 1 : k + 1] not in within), len(text)]
        return [text[a:b].encode("utf-8", "surrogateescape") for a, b in zip(cuts, cuts[1:])]

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave the two pieces as they are. Undoes the merges of both, latest first, and looks for one
        over the border between them that would have come before."""
        good, who, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        while len(who):
            key = a * len(self.rank) + b
            at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
            bad = (self.joins[at] == key) & (self.join_rank[at] < limit)
            good[who[bad]] = False
            on = ~bad & ((self.rank[a] > 0) | (self.rank[b] > 0))
            who, a, b = who[on], a[on], b[on]
            first, second = self.rank[a], self.rank[b]
            later = first > second  # of two equal merges the left one comes first
            limit = np.where(later, first, second + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return good

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_apart``, with a table of pairs met before; a pair may push another out."""
        key = a.astype(np.int64) * len(self.rank) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % SLOTS
        held = self.slots[slot]
        good = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            good[new] = self._apart(a[new].astype(np.int64), b[new].astype(np.int64))
            self.slots[slot[new]] = key[new] * 2 + good[new]
        return good

    def segment(self, words: list[bytes]) -> list[tuple[int, ...]]:
        order, lengths, text = self._lay(words)
        took, size = np.full((len(text) + 1, len(words)), -1, np.int32), np.ones((len(text) + 1, len(words)), np.int32)
        state = np.zeros(len(words), np.int64)
        for at in range(1, len(text) + 1):
            n = int(np.searchsorted(-lengths, -at, side="right"))
            state = self.goto[state[:n], self.letter[text[at - 1, :n]]].astype(np.int64)
            took[at, :n] = self.bytes[text[at - 1, :n]]  # stays where no piece ends
            link = np.where(self.piece[state] >= 0, state, self.output[state])
            live = np.flatnonzero(link >= 0)
            while len(live):
                node = link[live]
                last = self.piece[node]
                begin = at - self.length[node]
                before = took[begin, live]
                good = (begin == 0) | self.free[before]
                good &= self.made[last]
                ask = np.flatnonzero(~good & self.made[last])
                good[ask] = self.apart(before[ask], last[ask])
                who = live[good]
                took[at, who], size[at, who] = last[good], self.length[node[good]]
                link[live] = self.output[node]
                live = live[~good & (link[live] >= 0)]
        return self._back(order, lengths, took, size)


_automata: dict[int, Automaton] = {}


def automaton(vocabulary: Vocabulary, kind: type[Automaton] = Automaton) -> Automaton:
    """Built once a worker process."""
    key = hash((kind, len(vocabulary.pieces), vocabulary.scores.tobytes(), tuple(vocabulary.pieces)))
    if key not in _automata:
        _automata[key] = kind(vocabulary)
    return _automata[key]


def split_words(text: bytes) -> list[bytes]:
    """Cuts before each run of spaces. No piece of the model reaches over such a cut, as its signs for spaces come first;
    so the pieces of the words make up those of the text."""
    words, held = [], 0
    for part in text.split(b" "):
        if part:
            words.append(SPACE * (held + 1) + part)
            held = 0
        else:
            held += 1
    if held:
        words.append(SPACE * held)
    return words


class Encoder:
    """By best scores, or with ``merges`` as a BPE model encodes."""

    def __init__(self, vocabulary: Vocabulary, merges: bool = False):
        self.merges = merges
        self.automaton = automaton(vocabulary, Merges if merges else Automaton)
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.sign = tuple(int(self.automaton.bytes[b]) for b in SPACE)

    def _segment(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        out: dict[bytes, tuple[int, ...]] = {}
        words.sort(key=len)
        at = 0
        while at < len(words):
            to = at + 1  # the longest word, which comes last, makes every word's column as long; alone it may be of any length
            while to < len(words) and (len(words[to]) + 1) * (to + 1 - at) <= TOGETHER:
                to += 1
            out.update(zip(words[at:to], self.automaton.segment(words[at:to])))
            at = to
        return out

    def _learn(self, words: list[bytes]) -> None:
        if not self.merges:
            self.known.update(self._segment(words))
            return
        # Signs for spaces are merged with each other last: all but the one that the word's beginning may take.
        bare = [w[: len(SPACE) * (w.startswith(SPACE))] + w[self._signs(w) * len(SPACE) :] for w in words]
        parts = [self.automaton.cut(w) if len(w) > LONG else [w] for w in bare]
        found = self._segment(list({p for one in parts for p in one}))
        for word, one in zip(words, parts):
            ids = found[one[0]] if len(one) == 1 else tuple(i for p in one for i in found[p])
            signs = self._signs(word)
            if signs > 1:
                alone = ids[0] == self.automaton.sign
                ids = self.automaton.run(signs - 1 + alone) + ids[alone:]
            self.known[word] = ids

    @staticmethod
    def _signs(word: bytes) -> int:
        n = 0
        while word.startswith(SPACE, n * len(SPACE)):
            n += 1
        return n

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """A space is put before a text, as the model wants; an empty text has no pieces."""
        cut = [self._parts(t) for t in texts]
        new = {w for words in cut for w in words if w is not None}.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = {w for words in cut for w in words if w is not None}
        self._learn(list(new))
        known, sign = self.known, self.sign
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += sign if w is None else known[w]
            out.append(ids)
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    @staticmethod
    def _parts(text: bytes) -> list[bytes | None]:
        if not text:
            return []
        if SPACE not in text:
            return split_words(text)
        parts: list[bytes | None] = []
        for i, run in enumerate(text.split(SPACE)):  # None stands for the sign itself
            if i:
                parts.append(None)
            if run or not i:
                words = split_words(run)
                if i:  # no space before what follows a sign
                    words[0] = words[0][len(SPACE) :]
                parts += [w for w in words if w]
        return parts


def decode(vocabulary: Vocabulary, ids: list[int]) -> bytes:
    """The text: pieces put together, signs for spaces turned back, the first space taken off. Byte pieces stay as they are,
    so a sign that was part of the text comes back as itself."""
    return decoder(vocabulary)(ids)


def decoder(vocabulary: Vocabulary) -> Callable[[list[int]], bytes]:
    shown = [p if k == 1 else b"" if k == 2 else p.replace(SPACE, b" ") for p, k in zip(vocabulary.pieces, vocabulary.kinds)]

    def run(ids: list[int]) -> bytes:
        text = b"".join([shown[i] for i in ids])
        return text[1:] if text[:1] == b" " else text

    return run


def _encode(shared, check: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder, back = Encoder(vocabulary, vocabulary.splits is not None), decoder(vocabulary)
        for batch in batches:
            for rows, data, offsets in grams.pieces(batch, "text"):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                ids = encoder.encode(texts)
                sizes = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter((i for one in ids for i in one), np.int32, int(sizes[-1]))
                others = [c for c in rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in others),
                        pa.array(np.diff(sizes)),
                        pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(flat)),
                        pa.array([back(one) == t for one, t in zip(ids, texts)]) if check else pa.nulls(len(texts), pa.bool_()),
                    ],
                    names=[*others, "n_pieces", "piece_ids", "round_trip"],
                )

    return run


def encode_pieces(docs: DataFrame, model: str = MODEL, check: bool = True) -> DataFrame:
    """doc (the row's columns), n_pieces, piece_ids, round_trip of every row.

    Whole texts are encoded as the model does: by its merges if it is a BPE model, else by the best-scoring way through its
    pieces. What no piece covers comes as byte pieces, so decoding gives the very text back, and ``round_trip`` says whether
    it did. The sign for a space (U+2581) as part of a text comes as byte pieces too, where SentencePiece itself would take
    it for a space. Null and empty texts have no pieces.
    Nothing is shuffled; the vocabulary, whose size is the model's, goes to the tasks by broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    rows = docs.select(F.struct("*").alias("doc"), "text")
    added = [("n_pieces", T.LongType()), ("piece_ids", T.ArrayType(T.IntegerType())), ("round_trip", T.BooleanType())]
    return rows.mapInArrow(_encode(shared, check), T.StructType([rows.schema["doc"], *(T.StructField(*a) for a in added)]))


def _decode(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        back, size = decoder(vocabulary), len(vocabulary.pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED):
                rows = batch.slice(at, DECODED)
                texts, unknown = [], []
                for ids in rows.column("piece_ids").to_pylist():
                    known = [i for i in ids or () if i is not None and 0 <= i < size]
                    texts.append(None if ids is None else back(known).decode(errors="replace"))
                    unknown.append(len(ids or ()) - len(known))
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(texts, pa.string()), pa.array(unknown, pa.int64())], names=["row", "text", "n_unknown"])

    return run


def decode_pieces(encoded: DataFrame, model: str = MODEL, column: str = "piece_ids") -> DataFrame:
    """row (the row's columns), text, n_unknown of every row: the text whose pieces ``column`` holds, an array of ids.

    What ``encode_pieces`` gave comes back as the very text, what SentencePiece gave as it decodes it. A null array gives a
    null text, an empty one an empty text. Null ids and ids that the model doesn't have give nothing and are counted in
    ``n_unknown``; byte pieces that are no UTF-8 come as U+FFFD. Repeated rows are decoded each, an empty table gives no
    rows, and other columns may have any name. Nothing is shuffled.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    rows = encoded.select(F.struct("*").alias("row"), F.col(column).cast("array<long>").alias("piece_ids"))
    added = [("text", T.StringType()), ("n_unknown", T.LongType())]
    return rows.mapInArrow(_decode(shared), T.StructType([rows.schema["row"], *(T.StructField(*a) for a in added)]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs).select("doc.doc_id", "n_pieces", "piece_ids", "round_trip")
