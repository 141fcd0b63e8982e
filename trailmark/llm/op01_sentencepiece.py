"""SentencePiece encoding and decoding with a prefix table.

The vocabulary is a merge (BPE) model. For every prefix of a chunk of text the encoding ends with exactly one
token; an automaton over the vocabulary proposes the tokens that end there, and the one that is compatible with the
last token of the shorter prefix is stored. The ids are then recovered backwards from the end of the chunk. The
cost is linear in the text: no priority queue, and no trouble with very long words.

Defined results: a null text counts as empty (no ids, both digests those of the empty string); a null doc_id stays
null; each row is encoded by itself, so repeated rows give repeated results; an empty table gives no rows; columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import chain
from math import inf

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_pass

SPACE = "▁"
#: Entries that a worker's memory of encoded chunks, and of tested pairs, may hold.
CHUNKS, PAIRS = 250_000, 500_000
COLUMNS = "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string"


class Remembered(dict):
    """Ids by chunk, found when first asked for."""

    def __init__(self, encode_chunk: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.encode_chunk = encode_chunk

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.encode_chunk(chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


class PrefixTableEncoder:
    """Encodes as the sentencepiece library does with a merge model of identity normalisation."""

    def __init__(self, model_file: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [
            i
            for i in range(lib.get_piece_size())
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))
        ]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in ids}
        self.id = {lib.id_to_piece(i): i for i in ids}
        self.piece = {i: lib.id_to_piece(i) for i in ids}
        self.size = lib.get_piece_size()
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if self.merged(list(piece)) == [piece]:  # other pieces never come out of the merges
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.length = {i: len(piece) for i, piece in self.piece.items()}
        self.pairs: dict[int, bool] = {}
        self.traces: dict[str, list[tuple[float, str, str]]] = {}
        self.chunks = Remembered(self.encode_chunk)
        self.chunk = re.compile(self._chunk_pattern()).findall

    def _chunk_pattern(self) -> str:
        """Chunks between which no piece can reach, so that each can be encoded by itself."""
        inner = {c for piece in self.id if len(piece) > 1 for c in piece}
        apart = "".join(c for c in "\n\t\r" if c not in inner)
        if any(SPACE in piece.lstrip(SPACE) for piece in self.id):
            return r"(?s).+"
        if not apart:
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        return f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+|[{apart}]"

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges as they are defined: best score first, then leftmost. Used on the few characters of a pair."""
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def trace(self, token: str) -> list[tuple[float, str, str]]:
        """The merges that form a token, in order: the score of the next merge, and the outer symbols before it."""
        steps = self.traces.get(token)
        if steps is None:
            symbols, steps = list(token), []
            while len(symbols) > 1:
                at = max(range(len(symbols) - 1), key=lambda i: self.score.get(symbols[i] + symbols[i + 1], -inf))
                both = symbols[at] + symbols[at + 1]
                steps.append((self.score[both], symbols[0], symbols[-1]))
                symbols[at : at + 2] = [both]
            steps.append((-inf, token, token))
            self.traces[token] = steps
        return steps

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are when they stand side by side.

        Both form on their own, the better merge going first. They are apart as long as the two symbols that meet
        at the border never make the best merge of all (of equal ones the leftmost goes first).
        """
        a, b, score = self.trace(left), self.trace(right), self.score
        i = j = 0
        while True:
            (s, _, edge), (t, other, _) = a[i], b[j]
            across = score.get(edge + other)
            if across is not None and across > s and across >= t:
                return False
            if s == t == -inf:
                return True
            if s >= t:
                i += 1
            else:
                j += 1

    def fits(self, before: int, token: int) -> bool:
        known = self.pairs.get(before << 21 | token)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[before << 21 | token] = self.compatible(self._text(before), self._text(token))
        return known

    def encode_chunk(self, text: str) -> tuple[int, ...]:
        """last[e] is the token that ends the encoding of text[:e]; ids from `size` on are characters out of vocabulary."""
        last = [-1] * (len(text) + 1)
        length_of, known, size = self.length, self.pairs.get, self.size
        for end, token in self.automaton.iter(text):  # of the tokens that end at a place, the longest comes first
            end += 1
            if last[end] < 0:
                at = end - length_of[token]
                if at:
                    before = last[at]
                    if before < 0:
                        before = last[at] = size + ord(text[at - 1])
                    fits = known(before << 21 | token)
                    if not (self.fits(before, token) if fits is None else fits):
                        continue
                last[end] = token
        ids: list[int] = []
        end = len(text)
        while end:
            token = last[end]
            if 0 <= token < size:
                ids.append(token)
                end -= length_of[token]
            else:
                ids.extend(self.byte[b] for b in reversed(text[end - 1].encode()))
                end -= 1
        return tuple(reversed(ids))

    def _text(self, token: int) -> str:
        return self.piece[token] if token < self.size else chr(token - self.size)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        return list(chain.from_iterable(map(self.chunks.__getitem__, self.chunk(marked))))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encoder(model_file: str) -> PrefixTableEncoder:
    """One encoder a task: a Python worker outlives its task, and should not hold the tables in stages that follow."""
    return PrefixTableEncoder(model_file)


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, ids_sha256, decoded_sha256, row by row, without a shuffle."""

    def make() -> Callable:
        model = encoder(model_file)
        names = [str(i) for i in range(model.size)]

        def work(doc_ids, texts):
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = model.encode(text or "")
                joined = ",".join(map(names.__getitem__, ids))
                decoded = model.decode(ids) if ids else ""
                yield (
                    doc_id,
                    len(ids),
                    hashlib.sha256(joined.encode()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                )

        return work

    return text_pass(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), make, COLUMNS)


def encode_to_ids(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text -> doc_id, ids (array of int), the form that training reads."""
    import pyarrow as pa

    def run(batches):
        model = encoder(model_file)
        for batch in batches:
            ids = [model.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
