"""Numbers of tokens of whole texts, without making identifiers.

Pairs wait in a heap by rank and place, symbols form a linked list; the lowest pair is popped and merged until
none is left. A text's tokens are its first symbols less its merges, with the bytes of a character that the
vocabulary lacks as symbols of their own. Texts are cut where no piece of the vocabulary can span: before a word
mark that follows another character, and around characters that no longer piece holds. Counts of such units, and of
what stands between single spaces, are kept in dictionaries of bounded size, which forget those not met for long.

Null and empty texts have no tokens. Very long texts are counted whole; a unit of n characters takes n log n steps.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from windrow.llm.bpe import vocabulary
from windrow.llm.common import Recent

MARK = "▁"
PARTS = 1 << 19  # parts between spaces whose counts are kept, twice


def count_merged(symbols: list[str], ranks: dict[str, float], extra: Callable[[str], int]) -> int:
    """Symbols that are left when all merges are done; `extra` gives what a final symbol counts beyond one."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, s) for i in range(n - 1) if (r := ranks.get(s := symbols[i] + symbols[i + 1])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, s = heapq.heappop(heap)
        j = after[i]
        if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != len(s) or symbols[i] + symbols[j] != s:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = s, ""
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(t := s + symbols[k])) is not None:
                heapq.heappush(heap, (r, i, t))
        if (h := before[i]) >= 0 and (r := ranks.get(t := symbols[h] + s)) is not None:
            heapq.heappush(heap, (r, h, t))
    return n - merges + sum(extra(s) for s in symbols if s)


class Counter:
    def __init__(self, raw: bytes):
        model = proto.ModelProto()
        model.ParseFromString(raw)
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("the model is not a byte-pair model")
        kinds = proto.ModelProto.SentencePiece
        self.ranks = {p.piece: -p.score for p in model.pieces if p.type in (kinds.NORMAL, kinds.UNUSED)}
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces aren't handled")
        self.normal = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.plain = (not model.normalizer_spec.precompiled_charsmap and model.normalizer_spec.escape_whitespaces
                      and not model.normalizer_spec.remove_extra_whitespaces)
        self.prefix = model.normalizer_spec.add_dummy_prefix and not model.trainer_spec.treat_whitespace_as_suffix
        self.bytes = model.trainer_spec.byte_fallback
        longer = [p for p in self.ranks if len(p) > 1]
        inside = {c for p in longer for c in p}
        held = "".join(regex.escape(c) for c in sorted(inside - {MARK}))
        spans = any(p[i] != MARK and p[i + 1] == MARK for p in longer for i in range(len(p) - 1))
        letters = f"[{held}{MARK}]+" if spans else f"{MARK}+[{held}]*|[{held}]+"
        self.units = regex.compile(f"{letters}|.", regex.DOTALL)
        self.known: Recent[str, int] = Recent(self.unit)
        #: what stands between two single spaces is a text of its own if no longer piece has a mark behind other characters
        self.parts: Recent[str, int] | None = Recent(self.part, PARTS) if self.plain and self.prefix and not spans else None

    def unknown(self, symbol: str) -> int:
        """Tokens of a final symbol beyond one."""
        return len(symbol.encode()) - 1 if self.bytes and symbol not in self.ranks else 0

    def unit(self, text: str) -> int:
        return count_merged(list(text), self.ranks, self.unknown)

    def part(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.units.findall(MARK + text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.parts is not None and not (text[0] == " " or text[-1] == " " or "  " in text or MARK in text):
            return sum(map(self.parts.__getitem__, text.split(" ")))
        if self.plain:
            text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        else:
            text = self.normal.normalize(text)
        return sum(map(self.known.__getitem__, self.units.findall(text)))


@functools.lru_cache(maxsize=2)
def counter(raw: bytes) -> Counter:
    return Counter(raw)


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds (or replaces) the column `out`."""
    held = vocabulary(df.sparkSession, path)

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(held.value)
        for x in batches:
            yield pa.array([c.count(t.as_py()) for t in x], pa.int64())

    return df.withColumn(out, run(F.col(text)))
