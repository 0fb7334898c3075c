"""Public tokenizers inside tasks, and boundaries at which long texts may be
split without changing a token.

A *safe boundary* is one space between two characters that are neither white
space nor U+2581. The byte-level pattern starts a new piece at such a space.
The piece vocabulary has no entry in which U+2581 follows another character
(checked when a model is loaded), so no merge crosses it either. The parts of
a text on both sides are therefore encoded on their own. Each part is given
without its leading space: the piece model adds one itself, the byte-level
vocabulary gets it back from the caller.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import regex

_BOUNDARY = regex.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
_LOADED: dict[tuple, object] = {}


def once(make, *key):
    """``make(*key)``, computed once in a task's process."""
    if (make, *key) not in _LOADED:
        _LOADED[(make, *key)] = make(*key)
    return _LOADED[(make, *key)]


def safe_parts(text: str, size: int) -> list[str]:
    """``text`` cut at the first safe boundary after every ``size``
    characters; joined by spaces the parts are the text again."""
    out, at = [], 0
    while True:
        found = _BOUNDARY.search(text, at + size)
        if found is None:
            out.append(text[at:])
            return out
        out.append(text[at:found.start()])
        at = found.end()


class Pieces:
    """A sentencepiece model: ids of many texts, and the bytes of its tokens."""

    lead = ""  # what a part after a safe boundary gets back

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(names)]
        spaced = self.model.encode("a  b c ", out_type=str)
        #: Texts may be split at safe boundaries.
        self.splits = (not any("▁" in p.lstrip("▁") for p in names)
                       and "".join(spaced) == "▁a▁▁b▁c▁")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.model.encode(texts, num_threads=1, return_type="numpy")

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.encode(texts)]


class Plain:
    """A ``tokenizers`` file: lengths only, its special strings as it handles
    them by default. Byte-level vocabularies are split at safe boundaries, and
    a part that is not a text's first gets its leading space back."""

    lead = " "

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        kind = json.loads(self.model.to_str())
        cut = kind.get("pre_tokenizer") or {}
        specials = [t["content"] for t in kind.get("added_tokens", [])]
        self.splits = (cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
                       and kind.get("normalizer") is None and not any(" " in s for s in specials)
                       and not any(t["lstrip"] or t["rstrip"] for t in kind.get("added_tokens", [])))

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]


class ByteLevel:
    """A byte-level vocabulary file: ids of many texts without special tokens,
    and the bytes of its tokens.

    Texts whose characters all have the class they had in Unicode 3.2 are
    encoded by the faster library with the file's own ranks (used only where
    the file's merges are in the order of its ids); the two libraries may know
    different versions of Unicode, so other texts go to the file's own one."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        byte_of = _byte_letters()
        self.bytes = [b""] * max(max(vocab.values()) + 1, self.own.get_vocab_size())
        for token, i in vocab.items():
            if all(c in byte_of for c in token):
                self.bytes[i] = bytes(byte_of[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = vocab["".join(merges[0])] if merges else 0
        ranked = all(vocab["".join(m)] == first + k for k, m in enumerate(merges))
        ranks = {t: i for i, t in enumerate(self.bytes) if t}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks,
                                      special_tokens={}) if ranked else None
        self.known: set[str] = set()
        self.strange: set[str] = set()

    def _is_old(self, text: str) -> bool:
        letters = set(text)
        if letters <= self.known:
            return True
        if not letters.isdisjoint(self.strange):
            return False
        for c in letters - self.known:
            was, now = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
            same = was != "Cn" and (was[0] == now[0] or not {was[0], now[0]} & set("LNZ"))
            (self.known if same else self.strange).add(c)
        return letters <= self.known

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        slow = []
        for k, text in enumerate(texts):
            if self.fast is not None and self._is_old(text):
                out[k] = self.fast.encode_to_numpy(text, disallowed_special=())
            else:
                slow.append(k)
        if slow:
            got = self.own.encode_batch([texts[k] for k in slow], add_special_tokens=False)
            for k, e in zip(slow, got):
                out[k] = np.array(e.ids, dtype=np.uint32)
        return out


def _byte_letters() -> dict[str, int]:
    """The letter of every byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def counter_of(path: str):
    """The counting tokenizer of a file, by its suffix."""
    if path.endswith(".model"):
        return once(Pieces, path)
    if path.endswith(".json"):
        return once(Plain, path)
    raise ValueError(f"no counting library for {path}")
