"""Byte-level BPE encoding of whole texts inside tasks, from a public tokenizer file's JSON."""

from __future__ import annotations

import json
import os

import numpy as np

#: Texts above this many characters go to the tokenizer library itself: the faster encoder recurses over a run of blanks.
LONG_TEXT = 400_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, mapped back to the byte."""
    plain = [b for a, z in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(a), ord(z) + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Ids of whole texts, special strings taken as ordinary text.

    When the file's merges are numbered in the order of the vocabulary the ranks alone define the
    encoding, and the faster encoder of ``tiktoken`` gives the library's ids; else, and for very long
    texts, the ``tokenizers`` library is asked.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        parsed = json.loads(spec)
        vocab, special = parsed["model"]["vocab"], {t["content"] for t in parsed["added_tokens"]}
        letters = byte_letters()
        self.pieces = [b""] * (max([*vocab.values(), *(t["id"] for t in parsed["added_tokens"])]) + 1)
        for piece, i in vocab.items():
            if piece not in special:
                self.pieces[i] = bytes(letters[c] for c in piece)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parsed["model"]["merges"]]
        ordered = [vocab["".join(p)] for p in pairs] == list(range(256, 256 + len(pairs)))
        plain = parsed["normalizer"] is None and parsed["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False,
                                                                            "trim_offsets": True, "use_regex": True}
        self.fast = None
        if ordered and plain:
            import public_tokenizers
            import tiktoken
            ranks = {self.pieces[i]: i for piece, i in vocab.items() if piece not in special}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) <= LONG_TEXT:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


_LOADED: dict[str, ByteBPE] = {}


def byte_bpe(spec: str) -> ByteBPE:
    """The encoder of a tokenizer file's JSON, built once in each Python process."""
    if spec not in _LOADED:
        _LOADED[spec] = ByteBPE(spec)
    return _LOADED[spec]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
