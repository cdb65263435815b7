"""Rules over names, paths and types of model segments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extension -> format.
FORMATS = {"onnx": "onnx", "gguf": "gguf", "pb": "tensorflow", "pt": "pytorch", "pth": "pytorch", "h5": "hdf5", "hdf5": "hdf5"}

#: (parts of a name, role); the first that fits counts. Fixed values.
TENSOR_ROLES = (
    (("attn_q", "q_proj", ".wq", "attn_k", "k_proj", ".wk", "attn_v", "v_proj", ".wv", "attn_output", "o_proj", ".wo", "ffn_gate", "gate_proj", "w1", "ffn_down", "down_proj", "w2", "ffn_up", "up_proj", "w3"), "LINEAR"),
    (("token_embd", "tok_embeddings"), "TOKEN_EMBEDDING"),
    (("output",), "LINEAR"),
    (("norm",), "NORM"),
)
#: (parts of a name, segment kind); then the data type decides. Fixed values.
SEGMENT_KINDS = (
    (("token_embd", "tok_embeddings", "embedding", "output.weight"), "EMBEDDING_WEIGHTS"),
    (("attn", "attention"), "ATTENTION_WEIGHTS"),
    (("ffn", "feed_forward", "mlp"), "FEED_FORWARD_WEIGHTS"),
    (("norm", "ln_"), "LAYER_NORM_WEIGHTS"),
)
TYPE_KINDS = ((("f32", "f64"), "WEIGHTS_FP32"), (("f16", "bf16"), "WEIGHTS_FP16"), (("i8", "q8_0", "q8_1", "q8_k", "q6_k"), "WEIGHTS_INT8"), (("q4_0", "q4_1", "q5_0", "q5_1", "q2_k", "q3_k", "q4_k", "q5_k"), "WEIGHTS_INT4"))
#: Patterns whose first capture is a layer's number. Fixed values.
LAYER_PATTERNS = (
    r"(?:^|\.)(?:blk|block|layer|layers)\.([0-9]+)(?:\.|$)",
    r"(?:^|\.)(?:h)\.([0-9]+)(?:\.|$)",
    r"(?:^|\.)([0-9]+)\.(?:attn|ffn|mlp|norm)(?:\.|$)",
    r"(?:transformer|model)\.(?:h|layers)\.([0-9]+)(?:\.|$)",
)
#: Endings of tensor names and of layer names, in the order in which they are tried. Fixed values.
TENSOR_SUFFIXES = (".weight", ".bias", ".scales", ".weight_scale", ".weight_bias", ".gamma", ".beta")
NAME_SUFFIXES = (".weight", ".weights", ".bias", "/weight", "/weights", "/bias", "_weight", "_bias")
#: Layer type names as written in layer descriptions -> layer type. Fixed values.
LAYER_TYPES = {
    "conv": "CONV2D", "linear": "LINEAR", "gemm": "LINEAR", "matmul": "LINEAR", "dense": "LINEAR", "attention": "ATTENTION", "norm": "NORM", "layer_norm": "NORM",
    "batchnormalization": "BatchNormalization", "layernormalization": "LayerNormalization", "pool": "POOLING", "activation": "ACTIVATION", "add": "Add", "relu": "Relu", "sigmoid": "Sigmoid",
    "tanh": "Tanh", "softmax": "Softmax", "gelu": "Gelu", "leakyrelu": "LeakyRelu", "leaky_relu": "LeakyRelu", "elu": "Elu", "silu": "Silu", "swish": "Silu", "reshape": "Reshape", "transpose": "Transpose",
    "flatten": "Flatten", "concat": "Concat", "slice": "Slice", "gather": "Gather", "sub": "Sub", "mul": "Mul", "div": "Div", "maxpool": "MaxPool", "averagepool": "AveragePool", "avgpool": "AveragePool",
    "globalaveragepool": "GlobalAveragePool",
}


def has_any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def first_rule(c: Column, rules, otherwise: str) -> Column:
    """The label of the first rule of which a part occurs in c."""
    out = None
    for parts, label in rules:
        hit = has_any(c, parts)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def file_format(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv)), ext), F.lit("unknown"))


def format_of_bytes(content: Column) -> Column:
    """Format by the first bytes of a file."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "47475546", "gguf").when(head == "89484446", "hdf5").when(F.substring(head, 1, 4) == "504B", "pytorch").otherwise("unknown")


def tensor_role(name: Column) -> Column:
    return first_rule(F.lower(name), TENSOR_ROLES, "WEIGHTS")


def segment_kind(name: Column, data_type: Column) -> Column:
    """Kind by name, else by data type."""
    t = F.lower(data_type)
    by_type = None
    for types, kind in TYPE_KINDS:
        by_type = F.when(t.isin(*types), kind) if by_type is None else by_type.when(t.isin(*types), kind)
    named = first_rule(F.lower(name), SEGMENT_KINDS, "")
    return F.when(named != "", named).otherwise(by_type.otherwise("UNKNOWN"))


def layer_index(name: Column) -> Column:
    """The number of the first pattern that fits, 0 if none does."""
    found = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")).cast("long") for p in LAYER_PATTERNS]
    return F.coalesce(*found, F.lit(0))


def strip_suffix(name: Column, suffixes=TENSOR_SUFFIXES) -> Column:
    """The name without the first suffix of the list that it ends with; a name that is nothing but a suffix stays."""
    out = None
    for s in suffixes:
        hit = name.endswith(s) & (F.length(name) > len(s))
        cut = F.left(name, F.length(name) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(name)


def execution_name(layer_name: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(layer_name, F.lit("")), strip_suffix(name, NAME_SUFFIXES))


def decode_kind(data_format: Column, kind: Column) -> Column:
    """How a tensor is decoded: its format decides before its kind."""
    f = F.lower(F.coalesce(data_format, F.lit("")))
    by_kind = F.when(kind == "WEIGHTS_FP16", "FP16").when(kind == "WEIGHTS_INT8", "INT8").when(kind == "WEIGHTS_INT4", "INT4").otherwise("FP32")
    return F.when(f.isin("f16", "fp16"), "FP16").when(f == "bf16", "BF16").when(f.rlike("^q[0-9]"), "FP32").when(f.isin("i8", "int8"), "INT8").when(f.startswith("int4"), "INT4").otherwise(by_kind)


def effective_shape(dims: Column) -> Column:
    """(rows, cols): the first dimension and the product of the rest; zeros below two dimensions."""
    cols = F.aggregate(F.slice(dims, F.lit(2), F.greatest(F.size(dims) - 1, F.lit(0))), F.lit(1).cast("long"), lambda a, x: a * x)
    two = F.size(dims) >= 2
    return F.struct(F.when(two, F.get(dims, F.lit(0))).otherwise(0).cast("long").alias("rows"), F.when(two, cols).otherwise(0).cast("long").alias("cols"))


def protected(name: Column, depth: Column, n: int, total: int) -> Column:
    """Whether a tensor is a feed-forward tensor at the first or last n depths."""
    mlp = has_any(F.lower(name), ("mlp", "ffn", "feed_forward"))
    edge = (depth < n) | ((F.lit(total) > n) & (depth >= total - n))
    return mlp & edge


def named(name: Column, names: list[str]) -> Column:
    """Whether a tensor is protected by a set of names."""
    return name.isin(*names) if names else F.lit(False)


def layer_type(written: Column) -> Column:
    """Layer type of a name in a layer description; unknown names stay."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LAYER_TYPES.items() for x in kv)), F.lower(written)), written)


def operation(name: Column, kind: Column, weights: Column, biases: Column, kernel: Column, activation: Column, shapes: Column) -> Column:
    """What a layer without a registered operator does, by an ordered list of rules."""
    n, t = F.lower(name), F.lower(kind)
    return (
        F.when(has_any(t, ("concat", "slice", "add", "sub", "mul", "div", "reshape", "transpose", "flatten")), "elementwise")
        .when(has_any(n, ("attn", "attention")) | has_any(t, ("attention", "multihead")), "attention")
        .when(has_any(t, ("embedding",)) | has_any(n, ("token_embd", "tok_embeddings", "embedding")), "linear")
        .when(has_any(n, ("ln", "norm")) | has_any(t, ("norm",)), "normalization")
        .when(~weights & ~biases & (activation | has_any(t, ("relu", "gelu", "sigmoid", "tanh", "softmax"))), "activation")
        .when(~weights & ~biases & kernel & (has_any(t, ("pool",)) | has_any(n, ("pool",))), "pooling")
        .when(weights & kernel & (has_any(t, ("conv",)) | has_any(n, ("conv",))), "convolution")
        .when(weights & ~kernel & (has_any(t, ("linear", "matmul", "gemm", "dense")) | has_any(n, ("linear", "fc", "dense"))), "linear")
        .when(weights & shapes, F.when(kernel, "convolution").otherwise("linear"))
        .when(~weights & ~biases, "elementwise")
        .otherwise("unknown")
    )


#: (name of a pattern, regex of base and number) of files in parts. Fixed values.
PART_PATTERNS = (("of", r"^(.+)-([0-9]+)-of-[0-9]+\.[^.]+$"), ("suffix", r"^(.+)\.([0-9]+)$"), ("part", r"^(.+)_part([0-9]+)(?:\.[^.]+)?$"))


def file_part(name: Column) -> Column:
    """(base, pattern, number) of a file of a model in parts, null for other files."""
    out = None
    for label, p in PART_PATTERNS:
        part = F.struct(F.regexp_extract(name, p, 1).alias("base"), F.lit(label).alias("pattern"), F.nullif(F.regexp_extract(name, p, 2), F.lit("")).cast("long").alias("number"))
        out = F.when(name.rlike(p), part) if out is None else out.when(name.rlike(p), part)
    return out
