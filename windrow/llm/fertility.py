"""Quality rules: plain counts of words, symbols and repeats, and how public vocabularies cut a text.

A vocabulary that suits a language spends few tokens on it, seldom falls back to single bytes, and spreads its tokens over
many entries; markup, shouting, tables and repeated phrases show as too few characters a token, a high share of byte
tokens or too little entropy. Each measure has a band per language, or per script where the language has none of its own
or the text is not in its script. The entropy's floor is the band's, or SPREAD of the most that so few tokens can have.

Null and empty texts have no words and no tokens, fail the base rules and are not kept; rows with null ids are judged like
others; a null language counts as unknown. Repeated rows are judged one by one, columns that clash are replaced, an empty
table gives an empty one. Very long texts are measured whole. Windows of words are compared by 64-bit hashes.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from windrow.llm.bpe import vocabulary
from windrow.llm.common import shingle_hashes, word_hashes

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW = 8  # words
LEAST_WORDS, MOST_REPEATED = 20, 30  # words; repeated words in a hundred
SPREAD = 0.8
KEPT = 1 << 20  # parts of texts whose identifiers are kept
MARK = "▁"
#: a space beside other white space, which vocabularies may cut together with it
BESIDE = re.compile(r"\s | \s")


class Band(NamedTuple):
    """Limits of a language or script: characters a token in either vocabulary, byte tokens, bits of entropy."""
    piece: float
    ranks: float
    most: float = 12.0  # characters a token, either vocabulary
    bytes: float = 0.1
    entropy: float = 4.6


#: languages that have a band of their own; all are written in Latin letters
LANGUAGES = {"en": Band(2.0, 2.05, entropy=5.2), "fr": Band(1.9, 2.0, entropy=5.2), "es": Band(1.85, 2.0, entropy=5.2),
             "de": Band(1.95, 2.05, entropy=5.2)}
#: scripts by a pattern of their letters; the vocabularies hold few entries for most of them
SCRIPTS = {"latin": (r"[A-Za-zª-ɏḀ-ỿ]", Band(1.4, 1.4)),
           "greek": (r"[Ͱ-Ͽἀ-῿]", Band(0.7, 0.5, bytes=0.6)),
           "cyrillic": (r"[Ѐ-ԯ]", Band(1.2, 0.6, bytes=0.3)),
           "arabic": (r"[؀-ۿݐ-ݿ]", Band(0.6, 0.4, bytes=0.6)),
           "hebrew": (r"[֐-׿]", Band(0.6, 0.4, bytes=0.6)),
           "indic": (r"[ऀ-෿]", Band(0.3, 0.25, bytes=0.95)),
           "han": (r"[㐀-䶿一-鿿]", Band(0.35, 0.3, bytes=0.9)),
           "kana": (r"[぀-ヿ]", Band(0.45, 0.35, bytes=0.7)),
           "hangul": (r"[ᄀ-ᇿ가-힯]", Band(0.35, 0.25, bytes=0.95))}
OTHER = Band(0.25, 0.2, bytes=1.0, entropy=4.0)
_letters = {name: re.compile(pattern) for name, (pattern, _) in SCRIPTS.items()}


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def base(text: str) -> Base:
    found = text.encode().split()
    n = len(found)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeated = 0
    if n >= WINDOW:
        _, at, times = np.unique(shingle_hashes(word_hashes(found), WINDOW), return_inverse=True, return_counts=True)
        if len(times) < len(at):
            edges = np.zeros(n + 1, np.int64)
            starts = np.flatnonzero(times[at] > 1)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + WINDOW, -1)
            repeated = int((np.cumsum(edges[:n]) > 0).sum())
    return Base(n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
                repeated)


class Pieces:
    """A sentencepiece model; its byte pieces stand for characters that it lacks."""

    def __init__(self, raw: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        known = proto.ModelProto()
        known.ParseFromString(raw)
        rule = known.normalizer_spec
        longer = [p.piece for p in known.pieces if MARK in p.piece.lstrip(MARK)]
        #: whether a text's parts between single spaces are cut like texts of their own
        self.parts = (not rule.precompiled_charsmap and rule.escape_whitespaces and not rule.remove_extra_whitespaces
                      and rule.add_dummy_prefix and not longer)
        self.single = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def ids_of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all parts, and how many each has."""
        found = self.model.encode(parts, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, sizes.sum()), sizes


class Ranks:
    """A byte-level vocabulary as ranks; tokens that are no whole characters count as bytes."""

    parts = True  # the pattern leaves a single space to the word behind it

    def __init__(self, raw: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.single = np.zeros(max(ranks.values()) + 1, bool)
        self.bytes = np.zeros(len(self.single), np.int64)
        for piece, i in ranks.items():
            self.bytes[i] = len(piece)
            try:
                piece.decode()
            except UnicodeDecodeError:
                self.single[i] = True

    def ids(self, text: str) -> list[int]:
        return self.model.encode_ordinary(text)

    def ids_of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As of Pieces; the parts are cut as one text, and told apart by the bytes of their tokens."""
        parts = [" " + p for p in parts]
        ids = np.array(self.model.encode_ordinary("".join(parts)), np.int32)
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(p.encode()) for p in parts])) + 1
        return ids, np.diff(ends, prepend=0)


class Cut(NamedTuple):
    """How a vocabulary cuts a text."""
    n_tokens: int
    chars_per_token: float
    byte_share: float
    entropy: float


class Known:
    """Identifiers of parts met lately in each vocabulary, one behind the other, so that a text's are taken by place."""

    def __init__(self, *vocabularies: Pieces | Ranks):
        self.vocabularies, self.place = vocabularies, {}
        none = np.zeros(0, np.int64)
        self.held = [(none.astype(np.int32), none, none) for _ in vocabularies]  # identifiers, starts and sizes of the parts

    def learn(self, parts: set[str]) -> None:
        """Forgets all others if there would be too many."""
        if len(self.place) + len(parts) > KEPT or any(len(ids) > 8 * KEPT for ids, _, _ in self.held):
            self.__init__(*self.vocabularies)
        if not (new := [p for p in parts if p not in self.place]):
            return
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        for k, v in enumerate(self.vocabularies):
            if not v.parts:
                continue
            ids, starts, sizes = self.held[k]
            found, more = v.ids_of(new)
            ends = len(ids) + np.cumsum(more)
            self.held[k] = tuple(map(np.concatenate, ((ids, found), (starts, ends - more), (sizes, more))))

    def cuts(self, text: str, rest: list[str] | None) -> list[Cut]:
        """`rest` holds the parts behind the first one, or is null where the text must be cut as a whole."""
        out, at = [], None
        if rest is not None:
            first = text[:len(text) - sum(map(len, rest)) - len(rest)]
            at = np.fromiter(map(self.place.__getitem__, rest), np.int64, len(rest))
        for v, (ids, starts, sizes) in zip(self.vocabularies, self.held):
            if at is None or not v.parts:
                found = np.array(v.ids(text), np.int64)
            else:
                sizes = sizes[at]
                ends = np.cumsum(sizes)
                found = ids[np.repeat(starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
                found = np.concatenate([np.array(v.ids(first), np.int32), found])
            out.append(cut(found, len(text), v.single))
        return out


def cut(ids: np.ndarray, n_chars: int, single: np.ndarray) -> Cut:
    n = len(ids)
    if not n:
        return Cut(0, 0.0, 0.0, 0.0)
    times = np.bincount(ids, minlength=len(single))
    share = times[times > 0] / n
    return Cut(n, n_chars / n, float(times[single].sum() / n), max(0.0, float(-(share * np.log2(share)).sum())))


def parts_of(text: str) -> list[str] | None:
    """The parts of a text behind its first one, cut at spaces; null if a space stands beside other white space."""
    if not text or text[0] == " " or text[-1] == " " or BESIDE.search(text):
        return None
    return text.split(" ")[1:]


def script(text: str) -> str:
    """The script that most letters are in (of equals the first of SCRIPTS); "other" without such letters."""
    counts = {name: len(p.findall(text)) for name, p in _letters.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def band(text: str, lang: str | None) -> tuple[str, Band]:
    """The language's band if half of the text's characters or more are Latin-1, else its script's."""
    if lang in LANGUAGES and 2 * len(text.encode("latin-1", "ignore")) >= len(text):
        return lang, LANGUAGES[lang]
    name = script(text)
    return name, SCRIPTS[name][1] if name in SCRIPTS else OTHER


def reason(b: Band, pieces: Cut, ranks: Cut) -> str | None:
    """The first band that a text leaves; null if it stays within all."""
    if not b.piece <= pieces.chars_per_token <= b.most or not b.ranks <= ranks.chars_per_token <= b.most:
        return "characters per token"
    if pieces.byte_share > b.bytes:
        return "byte tokens"
    if pieces.entropy < min(b.entropy, SPREAD * float(np.log2(max(1, pieces.n_tokens)))):
        return "entropy"
    return None


@functools.lru_cache(maxsize=2)
def vocabularies(pieces: bytes, ranks: bytes, pattern: str) -> Known:
    return Known(Pieces(pieces), Ranks(ranks, pattern))


MEASURES = ("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,"
            "n_tokens:long,chars_per_token:double,byte_share:double,entropy:double,rank_chars_per_token:double,"
            "band:string,reason:string>")
_arrow = pa.struct([(n, t) for n, t in zip(
    [f.split(":")[0] for f in MEASURES[7:-1].split(",")],
    [pa.int64()] * 5 + [pa.bool_(), pa.int64()] + [pa.float64()] * 4 + [pa.string()] * 2)])


def measured(texts: list[str | None], langs: list[str | None], known: Known) -> Iterator[tuple]:
    texts = [t or "" for t in texts]
    parts = [parts_of(t) for t in texts]
    known.learn(set().union(*(p for p in parts if p)))
    for text, lang, rest in zip(texts, langs, parts):
        plain, (p, r) = base(text), known.cuts(text, rest)
        name, limits = band(text, lang)
        yield (*plain, plain.failed, *p, r.chars_per_token, name, reason(limits, p, r))


def measure(df: DataFrame, pieces: str, ranks: str, pattern: str, text: str = "text", lang: str | None = "lang",
            out: str = "measures") -> DataFrame:
    """Adds (or replaces) the column `out` with MEASURES; `reason` is null for texts within their bands.

    `pieces` is the path of a sentencepiece model, `ranks` of a byte-level vocabulary that is cut by `pattern`;
    without `lang` all texts are judged by script.
    """
    held = vocabulary(df.sparkSession, pieces), vocabulary(df.sparkSession, ranks)

    @F.arrow_udf(MEASURES)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        v = vocabularies(held[0].value, held[1].value, pattern)
        for texts, langs in batches:
            rows = list(measured(texts.to_pylist(), langs.to_pylist(), v))
            columns = zip(*rows) if rows else [[]] * len(_arrow)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow)], fields=list(_arrow))

    named: Column = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    return df.withColumn(out, run(F.col(text), named))


def kept(measures: str = "measures") -> Column:
    m = F.col(measures)
    return ~m["base_failed"] & m["reason"].isNull()
