"""Token sequences and tokenizer-side expressions that need no vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltworks.operators.cleaning import normalise, strip_space

#: Special tokens in their fixed order; names are configuration, the order is the protocol.
SPECIAL = ["<|pad|>", "<|unk|>", "<|bos|>", "<|eos|>", "<|im_start|>", "<|im_end|>", "<|think|>", "<|/think|>", "<|tool|>"]


def sequence_hash(ids: Column) -> Column:
    return F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), 256)


def digest_halves(text: Column) -> tuple[Column, Column]:
    """Two independent uniform values in [0, 1) from the first and the last 64 bits of one digest."""
    d = F.sha2(text, 256)
    part = lambda at: F.conv(F.substring(d, at, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))
    return part(1), part(49)


def split_reasoning(ids: Column, open_id: int, close_id: int, forced: bool = False) -> Column:
    """{reasoning, answer}: what starts with the opening mark (or is forced to) is reasoning up to the closing mark; without that there is no answer."""
    none = F.array().cast("array<int>")
    body = ids if forced else F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    started = F.lit(True) if forced else F.coalesce(F.get(ids, F.lit(0)) == open_id, F.lit(False))
    at = F.array_position(body, close_id).cast("int")
    inside = F.when(at > 0, F.struct(F.slice(body, F.lit(1), at - 1).alias("reasoning"), F.slice(body, at + 1, F.size(body)).alias("answer"))).otherwise(F.struct(body.alias("reasoning"), none.alias("answer")))
    return F.when(started, inside).otherwise(F.struct(none.alias("reasoning"), ids.alias("answer")))


def split_digits(text: Column) -> Column:
    """Pieces of the text, runs of digits cut from the right into threes. A run that stands behind a letter or one of ``. / - :`` is an identifier and stays whole."""
    run = F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def cut(piece: Column, i: Column) -> Column:
        n = F.length(piece)
        before = F.when(i > 0, F.right(F.get(run, i - 1), F.lit(1))).otherwise(F.lit(""))
        first = F.pmod(n, F.lit(3))
        groups = F.filter(F.concat(F.array(F.left(piece, first)), F.transform(F.sequence(F.lit(1), F.greatest(F.floor(n / 3).cast("int"), F.lit(1))), lambda k: F.substring(piece, first + (k - 1) * 3 + 1, F.lit(3)))), lambda x: x != "")
        return F.when(piece.rlike("^[0-9]") & (n > 3) & ~before.rlike(r"[A-Za-z./\-:]"), groups).otherwise(F.array(piece))

    return F.flatten(F.transform(run, cut))


def normaliser(*steps: tuple) -> callable:
    """A chain of ("nfc",), ("nfkc",), ("replace", pattern, by), ("strip",) applied to a text column."""

    def apply(c: Column) -> Column:
        for kind, *args in steps:
            if kind in ("nfc", "nfkc"):
                c = normalise(c, kind.upper())
            elif kind == "replace":
                c = F.regexp_replace(c, *args)
            elif kind == "strip":
                c = strip_space(c)
            else:
                raise ValueError(f"unknown step {kind!r}")
        return c

    return apply


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def piece_bytes(piece: Column) -> Column:
    """Number of bytes that a piece in that alphabet stands for: one per character."""
    return F.length(piece)


def special_token_problems(ids: dict[str, int]) -> list[str]:
    """What is wrong with the ids of the special tokens: missing ones, other order, gaps."""
    out = [f"missing {t}" for t in SPECIAL if t not in ids]
    have = [ids[t] for t in SPECIAL if t in ids]
    if have != sorted(have):
        out.append("order differs")
    if have and sorted(have) != list(range(min(have), min(have) + len(have))):
        out.append("ids aren't contiguous")
    return out


def round_trip_ok(text: Column, decoded: Column) -> Column:
    return text.eqNullSafe(decoded)


def declared_tokens(config: dict) -> list[str]:
    """Special tokens that a tokenizer's configuration declares: named ones and listed ones, texts or objects with ``content``, each once, in order."""
    named = [v for k, v in config.items() if k.endswith("_token")]
    listed = [*config.get("additional_special_tokens", []), *config.get("added_tokens_decoder", {}).values()]
    texts = [v if isinstance(v, str) else (v or {}).get("content") for v in [*named, *listed]]
    return list(dict.fromkeys(t for t in texts if t))


class Detokeniser:
    """Text of a stream of pieces of bytes, as far as it is whole: bytes of an unfinished character wait for the next piece."""

    def __init__(self):
        self.waiting = b""

    def push(self, piece: bytes) -> str:
        self.waiting += piece
        for cut in range(len(self.waiting), max(-1, len(self.waiting) - 4), -1):
            try:
                out = self.waiting[:cut].decode("utf-8")
            except UnicodeDecodeError:
                continue
            self.waiting = self.waiting[cut:]
            return out
        # no character is that long: what waits isn't text
        out, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return out

    def finish(self) -> str:
        out, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return out
