"""Token ids of whole texts by a public tokenizer file, with a bounded memo of words."""

from __future__ import annotations

import os

import numpy as np

def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


#: Added token whose single id marks word ends when many words are encoded at once.
_MARK = "<|endoftext|>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids for a tokenizer that lower-cases and whose pre-tokens span neither white space nor the
    border between a letter or digit and a comma or full stop.

    Such a tokenizer gives a text the ids of its words one after another, so each distinct word is
    encoded once and remembered, its closing commas and stops apart; the memo is emptied at ``most``
    words. Words of Latin letters alone, one pre-token each, go to the model directly.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.memo = Tokenizer.from_file(path), most, {}
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.mark = self.tokenizer.token_to_id(_MARK)
        self.model, self.letters = self.tokenizer.model, dict(enumerate(_byte_letters()))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _direct(self, word: bytes) -> str | None:
        """The word as the model reads it, if it is one pre-token of Latin letters."""
        if word.isalpha():
            return word.decode().lower()
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0180" and (low := text.lower()).isalpha():
            return low.encode().decode("latin-1").translate(self.letters)
        return None

    def _learn(self, words: list[bytes]) -> None:
        rest, memo, tokenize, form = [], self.memo, self.model.tokenize, self.kind
        for word in words:
            direct = self._direct(word)
            if direct is None:
                rest.append(word)
            else:
                memo[word] = b"".join([t.id.to_bytes(form.itemsize, "little") for t in tokenize(direct)])
        self._encode(rest)

    def _encode(self, words: list[bytes]) -> None:
        odd = [w for w in words if b"<|" in w] if self.mark is not None else words
        for word in odd:
            self.memo[word] = self._ids(word.decode("utf-8", "replace")).tobytes()
        plain = [w for w in words if b"<|" not in w] if odd else words
        if self.mark is None or not plain:
            return
        ids = self._ids(_MARK.join([w.decode("utf-8", "replace") for w in plain]))
        cuts = np.flatnonzero(ids == self.mark)
        raw, width = ids.tobytes(), self.kind.itemsize
        starts, ends = [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(raw)]
        for word, start, end in zip(plain, starts, ends, strict=True):
            self.memo[word] = raw[start:end]

    def _words(self, text: str | None) -> list[bytes]:
        if not text:
            return []
        raw = text.encode("utf-8", "replace")
        # added tokens are cased, and a combining mark may join a lower-case letter but not its capital
        return (raw if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        every = [self._words(t) for t in texts]
        known, memo = set().union(*every) if every else set(), self.memo
        new = known.difference(memo)
        if new:
            if len(memo) + len(new) > self.most:
                memo.clear()
                new = known
            joined = []
            for word in new:
                stem = word.rstrip(b".,")
                if len(stem) < len(word) and stem[-1:].isalnum():
                    joined.append((word, stem, word[len(stem):]))
            parts = new.difference(w for w, _, _ in joined).union(s for _, s, _ in joined).union(p for _, _, p in joined)
            self._learn(list(parts.difference(memo) if new is not known else parts))
            for word, stem, stops in joined:
                memo[word] = memo[stem] + memo[stops]
        return [np.frombuffer(b"".join([memo[w] for w in words]), self.kind) for words in every]
