"""Places and loading of the public tokenizers, once for each Python worker."""

from __future__ import annotations

import functools
import json
import os

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def path_of(name: str) -> str:
    """The file's path: as given if it is a path, else among the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def library(path: str):
    """The library's tokenizer, with padding and truncation off, single-threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[dict[str, int], tuple[tuple[str, int], ...]]:
    """The model's vocabulary and the added tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    return data["model"]["vocab"], tuple((t["content"], t["id"]) for t in data["added_tokens"])


#: Normalizer and pre-tokenizer of the named files, as the short cuts assume them. Fixed values.
SHAPES = {
    "byte": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "</w>",
    ),
}


@functools.lru_cache(maxsize=8)
def shape(path: str) -> str | None:
    """Which of SHAPES a file has, None for any other: then no short cut holds for it."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model = data["model"]
    odd = model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    tokens = data["added_tokens"]
    if odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in tokens) or not all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in tokens):
        return None
    for name, (normalizer, pre_tokenizer, suffix) in SHAPES.items():
        if (data["normalizer"], data["pre_tokenizer"], model.get("end_of_word_suffix")) == (normalizer, pre_tokenizer, suffix):
            return name
    return None


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others, in order, for the
    characters from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
