"""Sizes and schedules of proxy and target models: plain arithmetic on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping

# Depth -> (scaling parameters and all parameters in millions, width, heads).
DEPTHS: dict[int, tuple[float, float, int, int]] = {
    4: (3.2, 8.2, 256, 2),
    6: (17.6, 41.5, 384, 3),
    8: (40.4, 93.8, 512, 4),
    10: (70.2, 196.0, 640, 5),
    12: (110.1, 286.3, 768, 6),
    14: (164.2, 399.1, 896, 7),
    16: (234.9, 536.9, 1024, 8),
    18: (324.4, 701.9, 1152, 9),
    20: (435.2, 896.5, 1280, 10),
    22: (569.5, 1123.2, 1408, 11),
    24: (729.8, 1384.1, 1536, 12),
}
# Questions of each benchmark.
BENCHMARK_SIZES = {"arc_easy": 2376, "arc_challenge": 1172, "mmlu_stem": 3545, "gpqa_diamond": 198, "gsm8k_cot": 1319, "math_cot_500": 500}
DEFAULT_BENCHMARK_SIZE = 1000
TOKENS_PER_STEP = 500_000


def _up(x: int, unit: int) -> int:
    return -(-x // unit) * unit


def model_width(depth: int, aspect: int = 64, head_dim: int = 128) -> int:
    return _up(depth * aspect, head_dim)


def scaling_params(model: Mapping[str, int]) -> int:
    """Matrix and output parameters of a transformer described by its configuration."""
    layers, head_dim, aspect = model.get("n_layer", 24), model.get("head_dim", 128), model.get("aspect_ratio", 64)
    width = model.get("n_embd") or model_width(layers, aspect, head_dim)
    heads = model.get("n_head") or width // head_dim
    kv = model.get("n_kv_head", heads)
    vocab = _up(model.get("vocab_size", 32768), model.get("pad_vocab_size_to", 64))
    attention = width * heads * head_dim + 2 * width * kv * head_dim + width * width
    gates = sum(1 for i in range(layers) if i % 2 == (layers - 1) % 2) * kv * model.get("ve_gate_channels", 12)
    return layers * (attention + 8 * width * width) + gates + vocab * width


def model_info(depth: int, meta: Mapping | None = None) -> dict | None:
    """Sizes of a model, from its configuration if there is one, else from the table of depths."""
    if meta and "model_config" in meta:
        model = meta["model_config"]
        layers = model.get("n_layer", depth)
        width = model.get("n_embd") or model_width(layers, model.get("aspect_ratio", 64), model.get("head_dim", 128))
        millions = scaling_params(model) / 1e6
        return {"scaling_M": millions, "total_M": millions, "n_embd": width, "n_head": model.get("n_head") or width // model.get("head_dim", 128), "n_layer": layers}
    if depth not in DEPTHS:
        return None
    scaling, total, width, heads = DEPTHS[depth]
    return {"scaling_M": scaling, "total_M": total, "n_embd": width, "n_head": heads, "n_layer": depth}


def training_iterations(explicit: int | None, ratio: float | None, scaling: int | None) -> int:
    if explicit is not None:
        return explicit
    if ratio is not None and scaling is not None:
        return max(1, int(ratio * scaling / TOKENS_PER_STEP))
    return 1000


def general_shards(selected: int, ratio: float, shard_docs: int = 500_000) -> int:
    """General-data shards to blend with so many selected documents: between 3 and 50."""
    return min(50, max(3, math.ceil(selected * (1 - ratio) / ratio / shard_docs)))


def tree_params(samples: int, features: int, auto: bool = True, max_depth: int = 3, min_leaf: int = 3) -> tuple[int, int]:
    """(depth, documents in a leaf) of the regression trees for so many samples."""
    if not auto:
        return max_depth, min_leaf
    ratio = max(samples / max(features, 1), 2.0)
    return min(4, max(2, int(math.log2(ratio)) + 2)), max(3, min(5, samples // 20))


def column_fraction(features: int) -> float:
    return min(1.0, max(0.3, 20.0 / features))
