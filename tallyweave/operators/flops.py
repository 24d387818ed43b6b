"""Training work of a batch in floating-point operations, from its lengths alone.

A model counts as two parts: weights that every token meets (six operations each, forward and
backward) and attention layers, whose work is a sum over sequences of length times the span a token
looks at. So a batch of any size needs one aggregate: the lengths' sum, and for each kind of layer the
sum of length times least(length, window).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Peak operations a second of devices.
DEVICES = {
    "CPU": 448e9,
    "GB200": 2.5e15,
    "B200": 2.25e15,
    "MI300X": 1336e12,
    "H100": 989e12,
    "H800": 989e12,
    "H200": 989e12,
    "A100": 312e12,
    "A800": 312e12,
    "L40S": 362.05e12,
    "L40": 181.05e12,
    "A40": 149.7e12,
    "L20": 119.5e12,
    "H20": 148e12,
    "910B": 354e12,
    "Ascend910": 354e12,
    "RTX 3070 Ti": 21.75e12,
}
#: Units of a device's peak, a factor of 1000 apart.
UNITS = "BKMGTP"
#: The kind of each model family.
FAMILIES = {
    "qwen2": "dense",
    "llama": "dense",
    "qwen2_moe": "experts",
    "qwen2_vl": "dense",
    "qwen2_5_vl": "dense",
    "qwen3": "dense",
    "qwen3_moe": "experts",
    "qwen3_vl": "dense",
    "qwen3_vl_moe": "experts",
    "deepseek_v3": "latent",
    "minicpmv": "dense",
    "minicpmo": "dense",
    "mistral": "dense",
    "gemma3_text": "dense",
    "seed_oss": "dense",
    "apertus": "dense",
    "glm4v": "dense",
    "gpt_oss": "experts",
    "mimo": "dense",
}
#: Families whose layers look at a window, with its size and, where layers aren't listed, how often one looks at all.
WINDOWED = {"gemma3_text": (1024, 6), "gpt_oss": (128, None)}


@dataclass(frozen=True)
class Model:
    """weights: parameters that a token meets; layers: how many attend by window (None: the whole sequence); factor: operations of one layer a token and token looked at."""

    weights: int
    layers: Mapping[int | None, int]
    factor: int

    def work(self, length: Column) -> Column:
        """Operations on a sequence, forward and backward."""
        n = length.cast("double")
        spans = [n * (n if w is None else F.least(n, F.lit(float(w)))) * k for w, k in self.layers.items()]
        return n * (6.0 * self.weights) + sum(spans, F.lit(0.0)) * float(self.factor)


def _matrices(family: str, kind: str, c: Mapping) -> int:
    """Feed-forward weights of one layer that a token meets, its router included."""
    if kind == "dense":
        return c["hidden_size"] * c["intermediate_size"] * (2 if family == "apertus" else 3)
    width = c["intermediate_size"] if family == "gpt_oss" else c["moe_intermediate_size"]
    experts = next(c[k] for k in ("n_routed_experts", "num_local_experts", "num_experts") if k in c)
    return c["hidden_size"] * (3 * width * (c["num_experts_per_tok"] + c.get("n_shared_experts", 0)) + experts)


def _layers(family: str, c: Mapping) -> dict[int | None, int]:
    count = c["num_hidden_layers"]
    if family not in WINDOWED:
        return {None: count}
    window, every = c.get("sliding_window", WINDOWED[family][0]), WINDOWED[family][1]
    kinds = c.get("layer_types")
    if not kinds and every and window:
        every = c.get("sliding_window_pattern", every)
        kinds = ["full_attention" if every and not i % every else "sliding_attention" for i in range(1, count + 1)] if every else None
    near = sum(k == "sliding_attention" for k in (kinds or [])) if window else 0
    total = len(kinds) if kinds and family == "gpt_oss" else count
    return {k: v for k, v in ((window, near), (None, total - near)) if v}


def model(config: Mapping) -> Model | None:
    """The model that a configuration describes; None for an unknown family."""
    family = config["model_type"]
    kind = FAMILIES.get(family)
    if kind is None:
        return None
    c = config.get("text_config", config)
    hidden, heads, count = c["hidden_size"], c["num_attention_heads"], c["num_hidden_layers"]
    ends = 2 * c["vocab_size"] * hidden
    if kind == "latent":  # queries, keys and values through narrow latents; the first layers have no experts
        rope, plain, value, narrow = c["qk_rope_head_dim"], c["qk_nope_head_dim"], c["v_head_dim"], c["kv_lora_rank"]
        query, wide = c.get("q_lora_rank"), heads * (plain + rope)
        attention = hidden * wide if query is None else query * (hidden + wide)
        attention += hidden * (narrow + rope) + heads * narrow * (plain + value) + heads * value * hidden
        first = c["first_k_dense_replace"]
        weights = count * attention + (count - first) * _matrices(family, kind, c) + first * 3 * hidden * c["intermediate_size"] + ends
        return Model(weights, {None: count}, 3 * heads * (plain + rope + value))
    head = hidden // heads if family == "qwen3_vl" else c.get("head_dim") or hidden // heads
    pairs = c["num_key_value_heads"]
    layer = _matrices(family, kind, c) + 2 * hidden * head * (heads + pairs)
    if family == "apertus":  # norms of queries and keys
        layer += hidden + pairs * head
    return Model(layer * count + ends, _layers(family, c), 6 * head * heads)


def vision_model(config: Mapping) -> Model:
    """The image encoder of a configuration, over the lengths of images in patches."""
    v = config["vision_config"]
    dim, depth, merged = v["hidden_size"], v["depth"], v["hidden_size"] * v["spatial_merge_size"] ** 2
    patches = dim * v["in_channels"] * v["temporal_patch_size"] * v["patch_size"] ** 2
    mergers = (1 + len(v["deepstack_visual_indexes"])) * merged * (v["out_hidden_size"] + merged)
    return Model(patches + depth * dim * (2 * v["intermediate_size"] + 4 * dim) + mergers, {None: depth}, 12 * (dim // v["num_heads"]) * v["num_heads"])


def device_peak(name: str, unit: str = "T") -> float:
    """Peak operations a second of the device whose longest known name part `name` holds; infinite for unknown devices."""
    known = max((k for k in DEVICES if k in name), key=len, default=None)
    return DEVICES[known] / 1000 ** UNITS.index(unit) if known else float("inf")


def estimate(df: DataFrame, config: Mapping, seconds: float, *, length: str = "seqlen", device: str = "CPU", images: DataFrame | None = None, image_length: str = "seqlen") -> DataFrame:
    """One row: achieved and promised tera-operations a second. Null lengths count as 0; an unknown family achieves 0."""
    text = model(config)
    zero = F.lit(0.0)
    one = df.agg(F.coalesce(F.sum(text.work(F.col(length))), zero).alias("work") if text else zero.alias("work"))
    if images is not None and text and config.get("vision_config"):
        seen = images.agg(F.coalesce(F.sum(vision_model(config).work(F.col(image_length))), zero).alias("seen"))
        one = one.crossJoin(seen).select((F.col("work") + F.col("seen")).alias("work"))  # one row each
    return one.select((F.col("work") / seconds / 1e12).alias("achieved"), F.lit(device_peak(device)).alias("promised"))
