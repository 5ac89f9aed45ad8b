"""Token ids of the tokenizers library, each distinct word of a batch looked up once."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import common

# White space of Unicode and the four separators that Python's split() also takes.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
# Fixed value: the pattern of byte-level vocabularies that name none of their own.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file by its name; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, byte_level: bool) -> ChunkEncoder:
    """One for each Python worker, as common.kept has it."""
    return common.kept(("encoder", path, byte_level), lambda: ChunkEncoder(path, byte_level))


class ChunkEncoder(dict):
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    Neither kind of vocabulary merges across the white space between words: a byte-level tokenizer
    gives a space to the word that follows, a word tokenizer drops it. So the ids of a text whose
    words are parted by single spaces or line ends are those of its words, one after another; any
    other text goes to the library whole. Arrow tells a batch's distinct words, and their ids are gathered by
    place. A word of plain Latin letters is one piece of the model, which is called without the splitting
    rules; other ASCII words are cut by the vocabulary's own pattern; the rest pass through the whole tokenizer.
    The first `most` words are kept, later ones are encoded once a batch.
    """

    def __init__(self, path: str, byte_level: bool, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.size = self.dtype.itemsize
        self.byte_level, self.most = byte_level, most
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(plain)]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.pattern = self.splitting(json.loads(self.tokenizer.to_str())["pre_tokenizer"])
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}

    def splitting(self, rules: dict | None) -> regex.Pattern | None:
        """The pattern that cuts words into pieces, where the vocabulary names one; none: such words go to the library."""
        for r in (rules or {}).get("pretokenizers", [rules or {}]):
            if r.get("type") == "Split" and "Regex" in r["pattern"]:
                return regex.compile(r["pattern"]["Regex"])
            if r.get("type") == "ByteLevel" and r.get("use_regex"):
                return regex.compile(BYTE_LEVEL_PATTERN)
        return None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, word: str) -> bytes:
        shown = word if word.isascii() and " " not in word else word.encode().decode("latin1").translate(self.shown)
        return b"".join([t.id.to_bytes(self.size, "little") for t in self.model.tokenize(shown)])

    def kept_piece(self, word: str) -> bytes:
        out = self.pieces.get(word)
        if out is None:
            out = self.piece(word)
            if len(self.pieces) < self.most // 4:
                self.pieces[word] = out
        return out

    def word(self, word: str, before: str) -> bytes:
        tail = word[-1:] if word[-1:] in (".", ",") else ""
        body = word[:-1] if tail else word
        if body.isalpha() and max(body) < "ɐ" and "İ" not in body:
            if self.byte_level:
                return self.piece(before + body) + (self.kept_piece(tail) if tail else b"")
            return self.piece(body.lower()) + (self.kept_piece(tail) if tail else b"")
        if self.pattern is not None and word.isascii() and not any(map(word.__contains__, self.added)):
            return b"".join(map(self.kept_piece, self.pattern.findall(before + word if self.byte_level else word.lower())))
        return self.whole(before + word if self.byte_level else word)

    def __missing__(self, key: str) -> bytes:
        """key: a word after a space; or a line end and the word after it; or a zero and a text's first word."""
        if key[:1] == "\n":
            out = (self.whole("\n") if self.byte_level else b"") + self.word(key[1:], "")
        else:
            out = self.word(key[1:], "") if key[:1] == "\0" else self.word(key, " ")
        if len(self) < self.most:
            self[key] = out
        return out

    def simple(self, text: str) -> bool:
        """Words parted by single spaces or line ends alone."""
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or "\0" in text or any(map(text.__contains__, OTHER_SPACE)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.simple(text):
            return self.whole(text)
        first, *words = text.replace("\n", " \n").split(" ")
        return self.word(first, "") + b"".join(map(self.__getitem__, words))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of each text's."""
        n = np.zeros(len(texts), np.int64)
        there = [i for i, t in enumerate(texts) if t]
        split = [i for i in there if self.simple(texts[i])]
        parts: dict[int, np.ndarray] = {}
        for i in set(there) - set(split):
            parts[i] = np.frombuffer(self.whole(texts[i]), self.dtype)
            n[i] = len(parts[i])
        ids = np.empty(0, self.dtype)
        if split:
            marked = pa.array(["\0" + texts[i].replace("\n", " \n") for i in split], pa.large_string())
            words = pc.split_pattern(marked, " ")
            found = words.values.dictionary_encode()
            codes = found.indices.to_numpy()
            got = list(map(self.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)))
            length = np.fromiter(map(len, got), np.int64, len(got)) // self.size
            flat = np.frombuffer(b"".join(got), self.dtype)
            each = length[codes]
            ends = np.cumsum(each)
            ids = flat[np.repeat((np.cumsum(length) - length)[codes] - (ends - each), each) + np.arange(int(ends[-1]))]
            at = words.offsets.to_numpy()
            total = np.concatenate([[0], ends])
            n[split] = np.diff(total[at])
        if parts:  # the texts in their order
            starts = np.cumsum(n[split]) - n[split]
            for i, s in zip(split, starts.tolist(), strict=True):
                parts[i] = ids[s : s + n[i]]
            ids = np.concatenate([parts[i] for i in sorted(parts)])
        return ids, n
