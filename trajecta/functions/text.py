"""Prompt cleaning, templates, token packing and masks, as Columns.

Tokenisers are pluggable: `characters` is the stand-in used by queries and tests; any function Column -> array<int> may take its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a string's strip() knows it.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITE))


def clean_flow(prompt: Column) -> Column:
    """Stripped, underscores and line feeds to spaces, case kept."""
    return F.translate(strip(prompt), "_\n", "  ")


def clean_fast(prompt: Column) -> Column:
    """Lower case, stripped, underscores to spaces, line feeds kept."""
    return F.translate(strip(F.lower(prompt)), "_", " ")


def state_text(bins: Column) -> Column:
    return F.array_join(F.transform(bins, lambda b: b.cast("string")), " ")


def flow_prefix(prompt: Column, bins: Column) -> Column:
    return F.concat(F.lit("Task: "), clean_flow(prompt), F.lit(", State: "), state_text(bins), F.lit(";\nAction: "))


def fast_prefix(prompt: Column, bins: Column) -> Column:
    return F.concat(F.lit("Task: "), clean_fast(prompt), F.lit(", State: "), state_text(bins), F.lit(";\n"))


def characters(s: Column) -> Column:
    """Stand-in tokeniser: code points of the characters plus 3."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: (F.ascii(c) + 3).cast("int"))


@dataclass(frozen=True)
class Special:
    bos: int = 2
    eos: int = 1
    newline: int = 108
    pad: int = 0


def fitted(x: Column, size: int, fill: Column) -> Column:
    """Exactly `size` elements: cut, or filled at the end."""
    return F.concat(F.slice(x, 1, size), F.array_repeat(fill, F.greatest(F.lit(size) - F.size(x), F.lit(0))))


def pad_tokens(tokens: Column, size: int, pad: int = 0) -> tuple[Column, Column]:
    """Tokens of exactly `size` and the mask of the real ones."""
    return fitted(tokens, size, F.lit(pad).cast("int")), fitted(F.transform(tokens, lambda _: F.lit(True)), size, F.lit(False))


def encode_flow(prompt: Column, size: int, bins: Column | None = None, encode: Callable[[Column], Column] = characters, special: Special = Special()) -> tuple[Column, Column]:
    """Tokens and mask of the flow family: BOS, prompt and newline token, or with a state the discrete template."""
    body = F.concat(encode(clean_flow(prompt)), F.array(F.lit(special.newline))) if bins is None else encode(flow_prefix(prompt, bins))
    return pad_tokens(F.concat(F.array(F.lit(special.bos)), body), size, special.pad)


def pack_fast(prefix: Column, actions: Column | None, size: int, encode: Callable[[Column], Column] = characters, special: Special = Special()) -> dict[str, Column]:
    """tokens, mask, ar_mask and loss_mask: the prefix sees itself; the postfix (`Action: `, action tokens, bar, EOS) is causal and scored."""
    start = F.concat(F.array(F.lit(special.bos)), encode(prefix))
    end = F.concat(encode(F.lit("Action: ")), actions, encode(F.lit("|")), F.array(F.lit(special.eos))) if actions is not None else F.array().cast("array<int>")
    fill = lambda x, v, kind: F.transform(x, lambda _: F.lit(v).cast(kind))
    tokens, mask = pad_tokens(F.concat(start, end), size, special.pad)
    ar = fitted(F.concat(fill(start, 0, "int"), fill(end, 1, "int")), size, F.lit(0))
    loss = fitted(F.concat(fill(start, False, "boolean"), fill(end, True, "boolean")), size, F.lit(False))
    return {"tokens": tokens, "mask": mask, "ar_mask": ar, "loss_mask": loss}


def remap(token: Column, vocabulary: int, skipped: int = 128) -> Column:
    """Action ids to the tail of a text vocabulary, and back."""
    return F.lit(vocabulary - 1 - skipped) - token


def between_markers(text: Column) -> Column:
    """What stands between `Action: ` and the next bar; null without the marker."""
    return F.when(F.contains(text, F.lit("Action: ")), F.substring_index(F.element_at(F.split(text, "Action: ", 2), 2), "|", 1))


def action_tokens(tokens: Column, vocabulary: int, encode: Callable[[Column], Column] = characters) -> Column:
    """Action ids between the tokens of `Action: ` and of the next bar (or the end); null without the marker."""
    marker, bar = encode(F.lit("Action: ")), F.element_at(encode(F.lit("|")), 1)
    n = F.size(marker)
    at = F.get(F.filter(F.transform(tokens, lambda _, i: i), lambda i: F.slice(tokens, i + 1, n) == marker), 0)
    rest = F.slice(tokens, F.coalesce(at, F.lit(0)) + n + 1, F.size(tokens))
    end = F.array_position(rest, bar).cast("int")
    inner = F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(rest)
    return F.when(at.isNotNull(), F.transform(inner, lambda t: remap(t, vocabulary)))


def decode_bins(tokens: Column, horizon: int, dim: int, bins: int = 256) -> Column:
    """Tokens to [horizon][dim] values in [-1, 1]; zeros if there are fewer than horizon * dim (or null), the rest cut."""
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), dim), horizon)
    rows = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda k: F.transform(F.slice(tokens, k * dim + 1, F.lit(dim)), lambda t: t.cast("double") / bins * 2.0 - 1.0))
    return F.when(F.coalesce(F.size(tokens), F.lit(-1)) >= horizon * dim, rows).otherwise(zeros)


def running(x: Column) -> Column:
    """Running sums of an array."""
    last = lambda a: F.when(F.size(a) == 0, F.lit(0)).otherwise(F.try_element_at(a, F.lit(-1)))
    return F.aggregate(x, F.array().cast("array<int>"), lambda a, v: F.concat(a, F.array(last(a) + v.cast("int"))))


def positions(valid: Column) -> Column:
    """Running number of valid elements, less one."""
    return F.transform(running(valid), lambda n: n - 1)


def attention(ar: Column, valid: Column) -> Column:
    """mask[i][j]: j is visible to i if both are valid and the running sum of ar at j is at most that at i."""
    sums = running(ar)
    both = F.arrays_zip(sums.alias("s"), valid.alias("v"))
    return F.transform(both, lambda a: F.transform(both, lambda b: (b["s"] <= a["s"]) & a["v"] & b["v"]))


def next_token(tokens: Column) -> tuple[Column, Column]:
    """Inputs without the last, targets without the first."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n)


def right_align(x: Column, valid: Column) -> Column:
    """Rotated left so that the last valid element is last."""
    n = F.size(x)
    shift = F.greatest(F.array_max(F.transform(valid, lambda v, i: F.when(v, i + 1).otherwise(0))), F.lit(0)) % n
    return F.concat(F.slice(x, shift + 1, n - shift), F.slice(x, F.lit(1), shift))


def scatter(x: Column, places: Column, values: Column) -> Column:
    """x with values[k] at places[k]; of equal places the first."""
    return F.transform(x, lambda v, i: F.coalesce(F.get(values, F.when(F.array_position(places, i) > 0, F.array_position(places, i).cast("int") - 1)), v))


def step_key(folder: Column, file: Column, t: Column) -> Column:
    return F.concat_ws("--", folder, file, t.cast("string"))


def episode_of_file(name: Column) -> Column:
    """The id in metadata_<id>.json."""
    return F.regexp_extract(name, r"metadata_(.*)\.json$", 1)


def video_name(task: Column, episode: Column, success: Column) -> Column:
    return F.concat(F.lit("rollout_"), F.translate(task, " ", "_"), F.lit("_"), episode.cast("string"), F.when(success, "_success").otherwise("_failure"), F.lit(".mp4"))
