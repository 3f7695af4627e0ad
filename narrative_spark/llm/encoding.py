"""Exact, memoised encoding with the ``tokenizers`` library.

A tokenizer whose pre-tokenizer never joins characters across white space gives a text the ids of its space-delimited
pieces, one after another. The encoders below therefore ask the library for each distinct piece once and join the
remembered ids. Every id comes from the library; texts in which the boundary rule could matter take a general path.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

#: Pre-tokenization patterns of the two kinds of vocabulary files (fixed values of the formats).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a file has to say of itself for its texts to be cut here; any other file's texts go to the library whole (fixed
#: values of the formats).
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
SETTINGS = {
    "word": {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}, {**_BYTE_LEVEL, "use_regex": False}],
        },
    },
    "byte": {"normalizer": None, "pre_tokenizer": {**_BYTE_LEVEL, "use_regex": True}},
}
#: Below it no character changes under NFC, and lower-casing a letter doesn't depend on its neighbours.
LATIN_END = "\u0130"
#: Marks that often end a word, and are parts of their own behind it.
MARKS = ".,;:!?"
#: New words of a line that goes to the library as one text, and lines of one batch.
LINE, LINES = 512, 16
#: Entries of a memo of words, of one of byte-level words, which repeat less, and of one of parts of other pieces.
MEMO_ENTRIES, BYTE_MEMO_ENTRIES, PART_ENTRIES = 400_000, 1_000_000, 50_000
MEMO_KEY = 96
_LOADED: dict[tuple[str, str], "Encoder | WholeTexts | PieceModel"] = {}


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is, or a name of the installed public vocabulary files."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def cut_here(kind: str, path: str) -> bool:
    """Whether a vocabulary file has just the settings that the encoders of this module rely on."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and not any(map(str.isspace, t["content"])) for t in own.get("added_tokens") or [])
    model = own.get("model") or {}
    usual = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    return plain and usual and own.get("post_processor") is None and all(own.get(k) == v for k, v in SETTINGS[kind].items())


def encoder(kind: str, name_or_path: str) -> "Encoder | WholeTexts | PieceModel":
    """The encoder of this Python process; ``kind`` is ``word`` or ``byte``."""
    key = (kind, name_or_path)
    if key not in _LOADED:
        path = tokenizer_path(name_or_path)
        if path.endswith(".model"):
            _LOADED[key] = PieceModel(path)
        else:
            _LOADED[key] = {"word": WordEncoder, "byte": ByteEncoder}[kind](path) if cut_here(kind, path) else WholeTexts(path)
    return _LOADED[key]


def library(path: str):
    """The ``tokenizers`` library's own object, without padding and truncation, in this thread only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


def _as_ids(ids) -> bytes:
    import numpy as np

    return np.asarray(ids, dtype="<u4").tobytes()


class WholeTexts:
    """For any vocabulary of the ``tokenizers`` library: each text goes through it whole."""

    def __init__(self, path: str):
        self.library = library(path)

    def encode(self, texts) -> Iterator[bytes]:
        for text in texts:
            yield _as_ids(self.library.encode(text if isinstance(text, str) else text.decode("utf-8"), add_special_tokens=False).ids)


class PieceModel:
    """For ``sentencepiece`` files: each text goes through that library whole."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts) -> Iterator[bytes]:
        for text in texts:
            yield _as_ids(self.library.encode(text if isinstance(text, str) else text.decode("utf-8"), add_bos=False, add_eos=False))


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for U+0100 and on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo(dict):
    """A dict that computes what it lacks and keeps it while there is room; the first comers are the frequent ones."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= MEMO_KEY and len(self) < self.most:
            self[key] = value
        return value


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, memoised by piece.

    A new piece of plain Latin characters is pre-tokenized here and its parts go to the library's model; all other
    pieces, and those with strings of special tokens, go through the library as they are.
    """

    PATTERN = ""

    def __init__(self, path: str):
        import regex

        self.library = library(path)
        self.model = self.library.model
        self.pattern = regex.compile(self.PATTERN)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _byte_alphabet()
        self.parts = _Memo(self._part, PART_ENTRIES)

    def _normal(self, text: str) -> str:
        return text

    def _whole(self, text: str) -> bytes:
        return _as_ids(self.library.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        symbols = part if part.isascii() and part.isalnum() else part.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(symbols)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ask(self, text: str) -> bytes:
        """The ids of any piece that isn't a plain word."""
        if not text.isascii() and max(text) >= LATIN_END or any(s in text for s in self.specials):
            return self._whole(text)
        return b"".join(map(self.parts.__getitem__, self.pattern.findall(self._normal(text))))


def plain_word(text: str) -> tuple[str, str] | None:
    """A word of letters and the mark behind it, if a text is just that and the letters are plain ones."""
    if text.isalpha():
        return (text, "") if text.isascii() or max(text) < LATIN_END else None
    word = text[:-1]
    return (word, text[-1]) if word.isalpha() and text[-1] in MARKS and (word.isascii() or max(word) < LATIN_END) else None


class WordEncoder(Encoder):
    """For vocabularies that drop white space: pieces are the runs between ASCII white space.

    Other white space stays inside a piece and is left to the library.
    """

    PATTERN = WORD_PATTERN

    def _normal(self, text: str) -> str:
        return text.lower()

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        import numpy as np

        super().__init__(path)
        self.memo = _Memo(self._piece, entries)
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.last = np.zeros(self.library.get_vocab_size() + 1, dtype=bool)  # tokens that end a word
        self.last[[k for t, k in vocab.items() if t.endswith("</w>")]] = True

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new plain words, each one part to the pre-tokenizer, from batches of lines of words."""
        import numpy as np

        found = {}
        for at in range(0, len(words), LINE * LINES):
            lines = [words[k : k + LINE] for k in range(at, min(at + LINE * LINES, len(words)), LINE)]
            for line, one in zip(lines, self.library.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
                ids = np.asarray(one.ids, dtype="<u4")
                cuts, data = [0, *(4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()], ids.tobytes()
                if len(cuts) == len(line) + 1:
                    found.update(zip(line, (data[a:b] for a, b in zip(cuts, cuts[1:]))))
                else:  # no such line is known; word by word is always right
                    found.update((w, self._part(w)) for w in line)
        return found

    def fresh(self, pieces) -> dict[bytes, bytes]:
        """The ids of new pieces: plain words in batches of lines, others as they are."""
        split = {p: (self._normal(x[0]), x[1]) for p in pieces if (x := plain_word(p.decode("utf-8")))}
        words = self.learn(list({w for w, _ in split.values()}))
        found = {p: words[w] + self.parts[mark] if mark else words[w] for p, (w, mark) in split.items()}
        return found | {p: self._ask(p.decode("utf-8")) for p in pieces if p not in split}

    def _piece(self, piece: bytes) -> bytes:
        """The ids of a new piece; those of a word with a mark behind it from those of the word, if it is known."""
        text = piece.decode("utf-8")
        if (plain := plain_word(text)) is None:
            return self._ask(text)
        word, mark = plain
        if not mark:
            return self._part(word.lower())
        return (self.memo.get(piece[:-1]) or self._part(word.lower())) + self.parts[mark]

    def encode(self, texts) -> Iterator[bytes]:
        get = self.memo.__getitem__
        for text in texts:
            yield b"".join(map(get, text.split()))


class ByteEncoder(Encoder):
    """For byte-level vocabularies that keep white space as a prefix of the next piece."""

    PATTERN = BYTE_PATTERN

    def __init__(self, path: str):
        super().__init__(path)
        self.inner = _Memo(self._inner, BYTE_MEMO_ENTRIES)

    def _inner(self, word: str) -> bytes:
        """The ids of a word with the white space before it: a line feed that it holds, or else a space."""
        if word[0] == "\n":
            return self._ask("\n") + self._ask(word[1:]) if not word[1].isspace() else self._ask(word)
        if (plain := plain_word(word)) is None:
            return self._ask(" " + word)
        if not plain[1]:
            return self._part(" " + word)
        return (self.inner.get(plain[0]) or self._part(" " + plain[0])) + self.parts[plain[1]]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """With single spaces or line feeds between words only, a cut before each of them is a boundary of the
        pre-tokenizer. Any other text takes the pre-tokenizer's own pattern, or the library as it is."""
        get = self.inner.__getitem__
        for text in texts:
            words = text.split()
            if words and text.replace("\n", " ") == " ".join(words):
                if "\n" in text:
                    words = text.replace("\n", " \n").split(" ")
                first = self._ask(words[0])
                del words[0]
                yield first + b"".join(map(get, words))
            else:
                yield self._ask(text)


def by_bytes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to ``most`` at most, or that hold one item."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def safe_pieces(data: bytes, most: int) -> Iterator[bytes]:
    """Cut at ASCII white space into pieces of about ``most`` bytes; a run without white space stays whole."""
    start = 0
    while len(data) - start > most:
        cut = max(data.rfind(b" ", start + 1, start + most), data.rfind(b"\n", start + 1, start + most))
        if cut < 0:
            after = [x for x in (data.find(b" ", start + most), data.find(b"\n", start + most)) if x >= 0]
            if not after:
                break
            cut = min(after)
        yield data[start:cut]
        start = cut
    yield data[start:]
