"""Splitting text into a tokenizer's words, and encoding single words, exactly as the tokenizers library does."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .merges import LONGEST, Merges

#: Tab, newlines, printable ASCII and Latin letters to U+024F: here NFC changes
#: nothing and every Unicode version agrees on case, letters and digits.
#: Only superscript digits and fractions are left out: re takes them for letters.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xB1\xB4-\xB8\xBA\xBB\xBF-ɏ]*")
#: What re, faster than regex, makes of the supported pattern in that range.
_SUPPORTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: A sign beyond that range, for Arrow; and U+0130, the one whose lower case Arrow and the library see differently.
_BEYOND = r"[^\t\n\r\x20-\x7E\x{A1}-\x{B1}\x{B4}-\x{B8}\x{BA}\x{BB}\x{BF}-\x{12F}\x{131}-\x{24F}]"
_LETTERS_SIGNS = r"^(?P<a>[a-z]+)(?P<b>[!-&(-/:-@\[-`{-~]*)$"
#: Stretches, and bytes of them, after which a chunk ends.
CHUNK_TOKENS, CHUNK_BYTES = 4_000_000, 64 << 20


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next one from U+0100."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


class Chunk(NamedTuple):
    """Documents of one task, as numbers of their blank-parted stretches; every distinct stretch and word of them once.

    Stretch i consists of the words inner[starts[i]:starts[i + 1]].
    """

    doc_ids: pa.Array
    sizes: np.ndarray  # stretches of each document
    places: np.ndarray  # the number of each stretch
    starts: np.ndarray
    inner: np.ndarray
    words: pa.StringArray

    def slices(self, most: int = 500_000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(doc_ids, sizes, places) of some documents each, of about `most` stretches or one document."""
        ends = np.r_[0, np.cumsum(self.sizes)]
        a = 0
        while a < len(self.sizes):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
            yield self.doc_ids[a:b], self.sizes[a:b], self.places[ends[a] : ends[b]]
            a = b


def spread(starts: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[starts[i]:starts[i + 1]] for each i of at, one after the other, and how long each is."""
    k = starts[at + 1] - starts[at]
    ends = np.cumsum(k)
    return flat[np.repeat(starts[at] - ends + k, k) + np.arange(ends[-1] if len(ends) else 0)], k


def per_document(sizes: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The sums of k over each document's own sizes[i] entries."""
    sums = np.r_[0, np.cumsum(k)]
    ends = np.r_[0, np.cumsum(sizes)]
    return sums[ends[1:]] - sums[ends[:-1]]


class WordTokenizer:
    """A tokenizer file whose words are encoded independently: a regex split, byte letters, then BPE.

    Texts beyond the plain Latin range go through the library's own normalizer
    and splitter; others through the same pattern here, which is faster.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        steps = spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path} doesn't split its words in the way supported here")
        if split["pattern"]["Regex"] != _SUPPORTED:
            raise ValueError(f"{path} splits by {split['pattern']['Regex']}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.letters = _byte_letters()
        self.n_ids = self.tok.get_vocab_size()
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path} has a model that isn't supported here")
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, self.letters, model["end_of_word_suffix"] or "")

    def split(self, text: str | None) -> list[str]:
        """Normalised words and special tokens, in order; none for null and empty texts."""
        return [w for t in self.tokens(text) for w in self.words(t)]

    def tokens(self, text: str | None) -> list[str]:
        """Stretches between blanks, none of which a word crosses, lower-cased: what is worth remembering.

        Where a text has to go through the library, its words and special
        tokens instead, each behind a zero byte, which no stretch begins with.
        """
        if not text:
            return []
        if not any(s in text for s in self.special):
            return text.lower().split() if _PLAIN.fullmatch(text) else self._far(text)
        at, out = 0, []
        for m in self.cut.finditer(text):
            out += self._far(text[at : m.start()])
            out.append("\0" + m[0])
            at = m.end()
        return out + self._far(text[at:])

    def words(self, token: str) -> list[str]:
        """The words of one of tokens()."""
        return [token[1:]] if token[:1] == "\0" else _FAST.findall(token)

    def _tokens_of_all(self, texts: pa.StringArray) -> tuple[list[pa.StringArray], np.ndarray]:
        """tokens() of all texts in order, in pieces, and how many each text has. Texts of the plain range stay in Arrow; they may have empty tokens, which hold no word."""
        texts = pc.fill_null(texts, "")
        far = pc.match_substring_regex(texts, _BEYOND)
        for s in self.special:
            far = pc.or_(far, pc.match_substring(texts, s))
        cuts = np.flatnonzero(np.diff(np.r_[False, far.to_numpy(zero_copy_only=False), False].astype(np.int8)))
        out, sizes = [], []

        def near(a: int, b: int) -> None:
            if b > a:
                split = pc.ascii_split_whitespace(pc.utf8_lower(texts[a:b]))
                out.append(split.flatten())
                sizes.append(np.diff(split.offsets.to_numpy()))

        done = 0
        for a, b in cuts.reshape(-1, 2).tolist():
            near(done, a)
            for text in texts[a:b].to_pylist():
                own = self.tokens(text)
                out.append(pa.array(own, pa.string()))
                sizes.append(np.array([len(own)]))
            done = b
        near(done, len(texts))
        return out, np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)

    def chunks(self, batches: Iterable[pa.RecordBatch], most: int = CHUNK_TOKENS) -> Iterator[Chunk]:
        """Chunks of whole documents (doc_id, text), in order, of about `most` stretches."""
        ids, sizes, tokens, n, size = [], [], [], 0, 0
        for batch in batches:
            texts = batch.column("text")
            # A lot at a time, so that a batch of long texts makes several chunks.
            bytes_of = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(bytes_of, bytes_of[a] + (CHUNK_BYTES >> 3), "right")) - 1)
                own, k = self._tokens_of_all(texts[a:b])
                ids.append(batch.column("doc_id")[a:b])
                sizes.append(k)
                tokens += own
                n, size = n + int(k.sum()), size + int(bytes_of[b] - bytes_of[a])
                if n >= most or size >= CHUNK_BYTES:
                    yield self._chunk(ids, sizes, tokens)
                    ids, sizes, tokens, n, size = [], [], [], 0, 0
                a = b
        if ids:
            yield self._chunk(ids, sizes, tokens)

    def _chunk(self, ids: list, sizes: list[np.ndarray], tokens: list[pa.StringArray]) -> Chunk:
        coded = pa.chunked_array(tokens, pa.string()).dictionary_encode()
        places = np.concatenate([c.indices.to_numpy() for c in coded.chunks]) if coded.num_chunks else np.zeros(0, np.int32)
        distinct = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
        # Most are letters, and signs after them in many: a word, and the signs as another one.
        parts = pc.extract_regex(distinct, _LETTERS_SIGNS)
        odd = pc.is_null(parts).to_numpy(zero_copy_only=False)
        rest = [self.words(t) for t in distinct.filter(pa.array(odd)).to_numpy(zero_copy_only=False)]
        head, tail = pc.struct_field(parts, "a").filter(pa.array(~odd)), pc.struct_field(parts, "b").filter(pa.array(~odd))
        signs = pc.not_equal(tail, "")
        k = np.ones(len(distinct), np.int64)
        k[~odd] += signs.to_numpy(zero_copy_only=False)
        k[odd] = [len(x) for x in rest]
        starts = np.r_[0, np.cumsum(k)]
        both = pa.concat_arrays([head, tail.filter(signs), pa.array([w for x in rest for w in x], pa.string())]).dictionary_encode()
        number, kind = both.indices.to_numpy(), np.full(starts[-1], 2, np.int8)
        kind[starts[:-1][~odd]] = 0
        kind[starts[:-1][~odd & (k > 1)] + 1] = 1
        inner = np.empty(starts[-1], np.int32)
        inner[kind == 0], inner[kind == 1], inner[kind == 2] = np.split(number, np.cumsum([len(head), (kind == 1).sum()]))
        return Chunk(pa.concat_arrays(ids), np.concatenate(sizes), places, starts, inner, both.dictionary)

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids): the ids of word i are ids[starts[i]:starts[i + 1]]."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        lengths = np.diff(offsets).astype(np.int64)
        apart = (lengths > LONGEST) | (lengths == 0) | pc.is_in(words, pa.array([*self.special], pa.string())).to_numpy(zero_copy_only=False)
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
        if not apart.any():
            ids, k = self.merges.encode(data, lengths)
            return np.r_[0, np.cumsum(k)], ids
        whole = np.repeat(apart, lengths)
        ids, k = self.merges.encode(data[~whole], lengths[~apart])
        own = [self.encode_word(w) for w in words.filter(pa.array(apart)).to_pylist()]
        n = np.zeros(len(words), np.int64)
        n[~apart], n[apart] = k, [len(x) for x in own]
        out, here = np.empty(n.sum(), np.int32), np.repeat(apart, n)
        out[~here], out[here] = ids, [i for x in own for i in x]
        return np.r_[0, np.cumsum(n)], out

    def _far(self, text: str) -> list[str]:
        norm = self.tok.normalizer.normalize_str(text)
        return ["\0" + norm[s:e] for _, (s, e) in self.tok.pre_tokenizer.pre_tokenize_str(norm)]

    def encode_word(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        mapped = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        if not mapped.isprintable() or " " in mapped:  # control characters have byte letters too
            mapped = "".join([self.letters[b] for b in word.encode()])
        return [t.id for t in self.tok.model.tokenize(mapped)]

    def pieces(self) -> list[tuple[int, str]]:
        """(id, piece) of the whole vocabulary, special tokens included."""
        return sorted((i, p) for p, i in self.tok.get_vocab(with_added_tokens=True).items())


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One a worker process."""
    return WordTokenizer(path)
