"""Queries of model rules, dictionary codes and quality metrics. Segment names are made from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.functions import models as M
from bitloom.operators import codecs as C
from bitloom.operators import dictionary as D
from bitloom.plans.registry import query
from bitloom.sources import coded
from bitloom.sources.tables import long_vectors, table, vectors

_LONG = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i FROM embeddings)"

_STEMS = ("blk.{}.attn_q.weight", "model.layers.{}.mlp.down_proj.weight", "h.{}.ln_1.bias", "token_embd.weight", "{}.ffn.w1", "output.weight", "transformer.h.{}.attn.c_proj.scales", "conv_{}.gamma", "lm_head", ".weight")
_STEM_LIST = ", ".join(f"'{s}'" for s in _STEMS)
_NAMES = f"""n AS (SELECT p_partkey, p_size, replace([{_STEM_LIST}][p_partkey % 10 + 1], '{{}}', CAST(p_size % 22 AS VARCHAR)) AS name,
    ['f32', 'f16', 'bf16', 'i8', 'q4_K', 'q6_K', 'q8_0', 'i32', 'int4_sym'][p_partkey % 9 + 1] AS dtype, CAST(p_size % 22 AS BIGINT) AS depth FROM part)"""
_TYPES = ("f32", "f16", "bf16", "i8", "q4_K", "q6_K", "q8_0", "i32", "int4_sym")


def _names(spark, d):
    k = F.col("p_partkey")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    depth = (F.col("p_size") % 22).cast("long")
    return table(spark, d, "part").select("p_partkey", "p_size", F.replace(pick(_STEMS), F.lit("{}"), depth.cast("string")).alias("name"), pick(_TYPES).alias("dtype"), depth.alias("depth"))


def _contains(c, parts):
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"


def _case(c, rules, otherwise):
    return "CASE " + " ".join(f"WHEN {_contains(c, parts)} THEN '{label}'" for parts, label in rules) + f" ELSE {otherwise} END"


@query("format_from_url", """
    SELECT page_id, coalesce(map {'onnx': 'onnx', 'gguf': 'gguf', 'pb': 'tensorflow', 'pt': 'pytorch', 'pth': 'pytorch', 'h5': 'hdf5', 'hdf5': 'hdf5'}[lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))], 'unknown') AS format
    FROM (SELECT page_id, url || ['.onnx', '.GGUF', '', '.pb', '.pth', '.hdf5', '.txt'][page_id % 7 + 1] AS path FROM pages)""")
def format_from_url(spark, d):
    """Model format of paths by their extension."""
    ext = F.get(F.array(*map(F.lit, (".onnx", ".GGUF", "", ".pb", ".pth", ".hdf5", ".txt"))), (F.col("page_id") % 7).cast("int"))
    return table(spark, d, "pages").select("page_id", M.file_format(F.concat("url", ext)).alias("format"))


@query("format_from_magic", """
    SELECT item_id, ['gguf', 'hdf5', 'pytorch', 'unknown'][item_id % 4 + 1] AS format FROM benchmark""")
def format_from_magic(spark, d):
    """Model format by the first bytes of a file."""
    head = F.get(F.array(*(F.unhex(F.lit(h)) for h in ("47475546", "89484446", "504B0304", "00"))), (F.col("item_id") % 4).cast("int"))
    return table(spark, d, "benchmark").select("item_id", M.format_of_bytes(F.concat(head, F.col("text").cast("binary"))).alias("format"))


@query("supported_formats", "SELECT unnest(['onnx', 'gguf', 'pb', 'pt', 'pth', 'h5', 'hdf5']) AS extension, unnest(['onnx', 'gguf', 'tensorflow', 'pytorch', 'pytorch', 'hdf5', 'hdf5']) AS format")
def supported_formats(spark, d):
    return spark.createDataFrame(list(M.FORMATS.items()), "extension string, format string")


@query("shard_discovery", """
    WITH f AS (SELECT 'model' || p_size % 9 || '-' || lpad(CAST(p_partkey % 5 + 1 AS VARCHAR), 5, '0') || '-of-' || lpad(CAST(p_size % 3 + 4 AS VARCHAR), 5, '0') || '.gguf' AS file FROM part),
    m AS (SELECT DISTINCT regexp_extract(file, '^(.+)-([0-9]+)-of-([0-9]+)(\\..+)$', 1) AS base, CAST(regexp_extract(file, '^(.+)-([0-9]+)-of-([0-9]+)(\\..+)$', 2) AS BIGINT) AS part, CAST(regexp_extract(file, '^(.+)-([0-9]+)-of-([0-9]+)(\\..+)$', 3) AS BIGINT) AS parts FROM f)
    SELECT base, parts, count(*) FILTER (part <= parts) AS found, count(*) FILTER (part BETWEEN 1 AND parts) = parts AS complete FROM m GROUP BY base, parts""")
def shard_discovery(spark, d):
    """Files of models in parts, and whether all parts are there."""
    name = F.concat(F.lit("model"), F.col("p_size") % 9, F.lit("-"), F.lpad((F.col("p_partkey") % 5 + 1).cast("string"), 5, "0"), F.lit("-of-"), F.lpad((F.col("p_size") % 3 + 4).cast("string"), 5, "0"), F.lit(".gguf"))
    pattern = r"^(.+)-([0-9]+)-of-([0-9]+)(\..+)$"
    get = lambda i: F.regexp_extract("file", pattern, i)
    m = table(spark, d, "part").select(name.alias("file")).select(get(1).alias("base"), get(2).cast("long").alias("part"), get(3).cast("long").alias("parts")).distinct()
    here = F.count(F.when(F.col("part").between(1, F.col("parts")), 1))
    return m.groupBy("base", "parts").agg(here.alias("found"), (here == F.col("parts")).alias("complete"))


@query("index_file_scan", """
    WITH w AS (SELECT page_id, unnest(regexp_split_to_array(regexp_replace(html, '[^0-9]+', ' ', 'g'), '[ ]+')) AS w FROM pages) SELECT page_id, CAST(w AS BIGINT) AS idx, count(*) AS n FROM w WHERE w <> '' AND length(w) < 18 GROUP BY ALL""")
def index_file_scan(spark, d):
    """Integers of texts as index lists; longer runs of digits are no indices."""
    words = table(spark, d, "pages").select("page_id", F.explode(F.split(F.regexp_replace("html", "[^0-9]+", " "), "[ ]+")).alias("w"))
    return words.filter("w <> '' AND length(w) < 18").groupBy("page_id", F.col("w").cast("long").alias("idx")).agg(F.count(F.lit(1)).alias("n"))


@query("role_case", f"WITH {_NAMES} SELECT p_partkey, {_case('lower(name)', M.TENSOR_ROLES, repr('WEIGHTS'))} AS role FROM n")
def role_case(spark, d):
    """Role of a tensor by parts of its name, first rule first."""
    return _names(spark, d).select("p_partkey", M.tensor_role(F.col("name")).alias("role"))


_TYPE_SQL = "CASE " + " ".join("WHEN lower(dtype) IN (" + ", ".join(f"'{t}'" for t in types) + f") THEN '{kind}'" for types, kind in M.TYPE_KINDS) + " ELSE 'UNKNOWN' END"


@query("segment_kind", f"WITH {_NAMES} SELECT p_partkey, {_case('lower(name)', M.SEGMENT_KINDS, _TYPE_SQL)} AS kind FROM n")
def segment_kind(spark, d):
    """Kind of a segment by name, then by data type."""
    return _names(spark, d).select("p_partkey", M.segment_kind(F.col("name"), F.col("dtype")).alias("kind"))


@query("weight_kinds", f"WITH {_NAMES}, k AS (SELECT {_case('lower(name)', M.SEGMENT_KINDS, _TYPE_SQL)} AS kind FROM n) SELECT kind, kind <> 'UNKNOWN' AS is_weight, count(*) AS n FROM k GROUP BY ALL")
def weight_kinds(spark, d):
    """Which kinds hold weights."""
    from bitloom.sources.archive import WEIGHT_KINDS

    k = segment_kind(spark, d)
    return k.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", F.col("kind").isin(*WEIGHT_KINDS).alias("is_weight"), "n")


_PATTERNS_SQL = ", ".join(f"CAST(nullif(regexp_extract(name, '{p}', 1), '') AS BIGINT)" for p in M.LAYER_PATTERNS)


@query("layer_index", f"WITH {_NAMES} SELECT p_partkey, coalesce({_PATTERNS_SQL}, 0) AS layer FROM n")
def layer_index(spark, d):
    """Number of a tensor's layer."""
    return _names(spark, d).select("p_partkey", M.layer_index(F.col("name")).alias("layer"))


def _suffix_sql(c, suffixes):
    return "CASE " + " ".join(f"WHEN suffix({c}, '{s}') AND length({c}) > {len(s)} THEN left({c}, length({c}) - {len(s)})" for s in suffixes) + f" ELSE {c} END"


@query("strip_suffix", f"WITH {_NAMES} SELECT p_partkey, {_suffix_sql('name', M.TENSOR_SUFFIXES)} AS stem FROM n")
def strip_suffix(spark, d):
    return _names(spark, d).select("p_partkey", M.strip_suffix(F.col("name")).alias("stem"))


@query("execution_name", f"WITH {_NAMES} SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'layer_' || depth ELSE {_suffix_sql('name', M.NAME_SUFFIXES)} END AS run_as FROM n")
def execution_name(spark, d):
    """The layer name, else the tensor's name without its suffix."""
    given = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("layer_"), F.col("depth"))).otherwise("")
    return _names(spark, d).select("p_partkey", M.execution_name(given, F.col("name")).alias("run_as"))


@query("execution_order", f"WITH {_NAMES} SELECT p_partkey, name, coalesce({_PATTERNS_SQL}, 0) AS layer FROM n ORDER BY name = '', layer, name, p_partkey")
def execution_order(spark, d):
    """Layers without a graph in their order: named ones by number and name."""
    n = _names(spark, d).select("p_partkey", "name", M.layer_index(F.col("name")).alias("layer"))
    return n.orderBy(F.col("name") == "", "layer", "name", "p_partkey")


@query("decode_kind", f"""WITH {_NAMES} SELECT p_partkey, CASE WHEN lower(dtype) IN ('f16', 'fp16') THEN 'FP16' WHEN lower(dtype) = 'bf16' THEN 'BF16' WHEN regexp_matches(lower(dtype), '^q[0-9]') THEN 'FP32'
    WHEN lower(dtype) IN ('i8', 'int8') THEN 'INT8' WHEN starts_with(lower(dtype), 'int4') THEN 'INT4' ELSE 'FP32' END AS decoded FROM n""")
def decode_kind(spark, d):
    """How a tensor of a data type is decoded."""
    return _names(spark, d).select("p_partkey", M.decode_kind(F.col("dtype"), F.lit("WEIGHTS_FP32")).alias("decoded"))


_DIMS = "CASE p_partkey % 4 WHEN 0 THEN [p_size] WHEN 1 THEN [p_size, 16] WHEN 2 THEN [p_size, 4, 8] ELSE [p_size * 8, 3, 3, 3] END"


def _dims():
    s = F.col("p_size").cast("long")
    lit = lambda *x: [F.lit(v).cast("long") for v in x]
    k = F.col("p_partkey") % 4
    return F.when(k == 0, F.array(s)).when(k == 1, F.array(s, *lit(16))).when(k == 2, F.array(s, *lit(4, 8))).otherwise(F.array(s * 8, *lit(3, 3, 3)))


@query("effective_shape", f"""
    SELECT p_partkey, CAST(CASE WHEN len(dims) >= 2 THEN dims[1] ELSE 0 END AS BIGINT) AS rows, CAST(CASE WHEN len(dims) >= 2 THEN list_product(dims[2:]) ELSE 0 END AS BIGINT) AS cols FROM (SELECT p_partkey, {_DIMS} AS dims FROM part)""")
def effective_shape(spark, d):
    """Two-dimensional shape of tensors of any rank."""
    return table(spark, d, "part").select("p_partkey", M.effective_shape(_dims()).alias("s")).select("p_partkey", "s.rows", "s.cols")


@query("dictionary_suitable", f"""
    WITH {_NAMES}, s AS (SELECT n.p_partkey, dtype, {_DIMS} AS dims FROM n), e AS (SELECT *, CASE WHEN len(dims) >= 2 THEN dims[1] ELSE 0 END AS r, CASE WHEN len(dims) >= 2 THEN list_product(dims[2:]) ELSE 0 END AS c FROM s)
    SELECT p_partkey, CASE WHEN len(dims) < 2 THEN 'rank' WHEN lower(dtype) IN ('i32', 'int4_sym') THEN 'type' WHEN r % 8 <> 0 OR c % 8 <> 0 THEN 'shape' ELSE 'ok' END AS reason FROM e""")
def dictionary_suitable(spark, d):
    """Why a tensor can not be coded in 8 x 8 tiles, or that it can."""
    s = _names(spark, d).join(table(spark, d, "part").select("p_partkey", _dims().alias("dims")), "p_partkey")
    shape = M.effective_shape(F.col("dims"))
    reason = F.when(F.size("dims") < 2, "rank").when(F.lower("dtype").isin("i32", "int4_sym"), "type").when((shape["rows"] % 8 != 0) | (shape["cols"] % 8 != 0), "shape").otherwise("ok")
    return s.select("p_partkey", reason.alias("reason"))


@query("protect_boundary", f"WITH {_NAMES} SELECT p_partkey, (contains(lower(name), 'mlp') OR contains(lower(name), 'ffn') OR contains(lower(name), 'feed_forward')) AND (depth < 3 OR depth >= 19) AS protected, name IN ('lm_head', 'output.weight') AS by_name FROM n")
def protect_boundary(spark, d):
    """Feed-forward tensors at the first and last three of 22 depths, and tensors protected by name."""
    return _names(spark, d).select("p_partkey", M.protected(F.col("name"), F.col("depth"), 3, 22).alias("protected"), M.named(F.col("name"), ["lm_head", "output.weight"]).alias("by_name"))


@query("role_config", f"WITH {_NAMES} SELECT CASE WHEN contains(lower(name), 'mlp') OR contains(lower(name), 'ffn') THEN 512 ELSE 256 END AS atoms, CASE WHEN contains(lower(name), 'mlp') OR contains(lower(name), 'ffn') THEN 8 ELSE 5 END AS active, count(*) AS tensors, CAST(sum(p_size) AS BIGINT) AS tiles FROM n GROUP BY ALL")
def role_config(spark, d):
    """Tensors grouped by the dictionary settings that their role asks for."""
    n = _names(spark, d)
    mlp = M.has_any(F.lower("name"), ("mlp", "ffn"))
    (ma, _, mk, _), (oa, _, ok, _) = D.ROLE_CONFIG["mlp"], D.ROLE_CONFIG["other"]
    return n.groupBy(F.when(mlp, ma).otherwise(oa).alias("atoms"), F.when(mlp, mk).otherwise(ok).alias("active")).agg(F.count(F.lit(1)).alias("tensors"), F.sum("p_size").cast("long").alias("tiles"))


#: Every name that a layer description may hold, and one that none does.
_WRITTEN = (*M.LAYER_TYPES, "Custom")


@query("layer_metadata", f"""
    WITH m AS (SELECT p_partkey, 'type ' || [{", ".join(f"'{w}'" for w in _WRITTEN)}][p_partkey % {len(_WRITTEN)} + 1] || ' kernel ' || p_size % 5 || ' stride 2' AS s FROM part),
    k AS (SELECT p_partkey, string_split(s, ' ') AS w FROM m)
    SELECT p_partkey, coalesce(map {{{", ".join(f"'{k}': '{v}'" for k, v in M.LAYER_TYPES.items())}}}[lower(w[2])], w[2]) AS layer_type, CAST(w[4] AS INT) AS kernel, CAST(w[6] AS INT) AS stride FROM k""")
def layer_metadata(spark, d):
    """Layer descriptions of keys and values, with every layer name."""
    kind = F.get(F.array(*map(F.lit, _WRITTEN)), (F.col("p_partkey") % len(_WRITTEN)).cast("int"))
    text = F.concat(F.lit("type "), kind, F.lit(" kernel "), F.col("p_size") % 5, F.lit(" stride 2"))
    pairs = F.str_to_map(F.regexp_replace(text, r"([^ ]+) ([^ ]+)( |$)", "$1=$2;"), F.lit(";"), F.lit("="))
    m = table(spark, d, "part").select("p_partkey", pairs.alias("m"))
    return m.select("p_partkey", M.layer_type(F.col("m")["type"]).alias("layer_type"), F.col("m")["kernel"].cast("int").alias("kernel"), F.col("m")["stride"].cast("int").alias("stride"))


_FLAGS = "p_size % 2 = 0 AS w, p_size % 3 = 0 AS b, p_size % 5 < 2 AS k, p_size % 7 = 0 AS a, p_size % 4 > 0 AS s"
_KINDS = ("Conv", "MatMul", "Relu", "MaxPool", "LayerNorm", "Concat", "Custom", "Embedding", "MultiheadAttention")


@query("operation_rules", f"""
    WITH {_NAMES}, x AS (SELECT p_partkey, lower(name) AS n, lower(['{"', '".join(_KINDS)}'][p_partkey % 9 + 1]) AS t, {_FLAGS} FROM n)
    SELECT p_partkey, CASE WHEN {_contains('t', ('concat', 'slice', 'add', 'sub', 'mul', 'div', 'reshape', 'transpose', 'flatten'))} THEN 'elementwise'
        WHEN {_contains('n', ('attn', 'attention'))} OR {_contains('t', ('attention', 'multihead'))} THEN 'attention'
        WHEN contains(t, 'embedding') OR {_contains('n', ('token_embd', 'tok_embeddings', 'embedding'))} THEN 'linear'
        WHEN {_contains('n', ('ln', 'norm'))} OR contains(t, 'norm') THEN 'normalization'
        WHEN NOT w AND NOT b AND (a OR {_contains('t', ('relu', 'gelu', 'sigmoid', 'tanh', 'softmax'))}) THEN 'activation'
        WHEN NOT w AND NOT b AND k AND (contains(t, 'pool') OR contains(n, 'pool')) THEN 'pooling'
        WHEN w AND k AND (contains(t, 'conv') OR contains(n, 'conv')) THEN 'convolution'
        WHEN w AND NOT k AND ({_contains('t', ('linear', 'matmul', 'gemm', 'dense'))} OR {_contains('n', ('linear', 'fc', 'dense'))}) THEN 'linear'
        WHEN w AND s THEN CASE WHEN k THEN 'convolution' ELSE 'linear' END WHEN NOT w AND NOT b THEN 'elementwise' ELSE 'unknown' END AS operation FROM x""")
def operation_rules(spark, d):
    """What layers of unregistered types do."""
    p = F.col("p_size")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 9).cast("int"))
    op = M.operation(F.col("name"), kind, p % 2 == 0, p % 3 == 0, p % 5 < 2, p % 7 == 0, p % 4 > 0)
    return _names(spark, d).select("p_partkey", op.alias("operation"))


@query("prompt_template", """
    SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND NOT contains(text, '<|im_start|>') THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE text END AS prompt FROM conversations WHERE role = 'user'""")
def prompt_template(spark, d):
    """User turns wrapped in a chat template where the model (even conversations) asks for it."""
    from bitloom.functions.text import apply_template

    path = F.when(F.col("conv_id") % 2 == 0, "Qwen2-7B-Instruct.gguf").otherwise("tinyllama.gguf")
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", apply_template(F.col("text"), path).alias("prompt"))


@query("tile_extract", f"WITH {_LONG} SELECT vec_id, (i // 32) * 2 + (i % 8) // 4 AS tile, round(sum(v), 6) + 0.0 AS total, count(*) AS n FROM v GROUP BY vec_id, (i // 32) * 2 + (i % 8) // 4")
def tile_extract(spark, d):
    """4 x 4 tiles of 8 x 8 matrices."""
    i = F.col("i")
    t = D.tile_of(F.floor(i / 8), i % 8, 4, 4, 8)
    return long_vectors(spark, d).groupBy("vec_id", t.cast("long").alias("tile")).agg((F.round(F.sum("v"), 6) + 0.0).alias("total"), F.count(F.lit(1)).alias("n"))


@query("edge_strips", f"WITH {_LONG} SELECT vec_id, i, round(v, 6) + 0.0 AS v FROM v WHERE i // 8 >= 6 OR i % 8 >= 6")
def edge_strips(spark, d):
    """Entries outside the full 3 x 3 tiles, kept as they are."""
    i = F.col("i")
    return long_vectors(spark, d).filter((F.floor(i / 8) >= 6) | D.tile_of(F.floor(i / 8), i % 8, 3, 3, 8).isNull()).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


_ATOMS_SQL = "atoms AS (SELECT CAST(a AS BIGINT) AS atom, CAST(i AS BIGINT) AS i, (((a * 13 + i * 7) % 23) - 11) / 23.0::DOUBLE AS w FROM (SELECT unnest(range(32)) AS a), (SELECT unnest(range(64)) AS i))"
_CODES_SQL = "codes AS (SELECT vec_id AS tile, s AS stage, k AS slot, (vec_id * 5 + s * 11 + k * 3) % 32 AS atom, CASE WHEN (vec_id + s + k) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM embeddings, (SELECT unnest(range(3)) AS s), (SELECT unnest(range(2)) AS k))"


def _atoms(spark):
    """A fixed dictionary of 32 atoms."""
    both = spark.range(32 * 64).select(F.floor(F.col("id") / 64).alias("atom"), (F.col("id") % 64).alias("i"))
    return both.select("atom", "i", (((F.col("atom") * 13 + F.col("i") * 7) % 23 - 11) / F.lit(23.0)).alias("w"))


def _codes(spark, d):
    """Fixed codes of every vector: three stages of two signed atoms."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("stage")).select("tile", "stage", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("slot"))
    t, s, k = F.col("tile"), F.col("stage"), F.col("slot")
    return v.select("tile", "stage", "slot", ((t * 5 + s * 11 + k * 3) % 32).alias("atom"), F.when((t + s + k) % 2 == 0, 1).otherwise(-1).alias("sign"))


@query("code_pack", f"WITH {_CODES_SQL} SELECT tile, CAST(stage AS INT) AS stage, CAST(slot AS INT) AS slot, atom + CASE WHEN sign < 0 THEN 32768 ELSE 0 END AS code, atom, CAST(sign AS INT) AS sign FROM codes")
def code_pack(spark, d):
    """Atom and sign in one number, and out again."""
    c = _codes(spark, d).select("tile", "stage", "slot", D.pack_code(F.col("atom"), F.col("sign")).alias("code"))
    return c.select("tile", "stage", "slot", "code", D.unpack_code(F.col("code")).alias("u")).select("tile", "stage", "slot", "code", "u.atom", "u.sign")


@query("dictionary_decode", f"WITH {_ATOMS_SQL}, {_CODES_SQL} SELECT tile, i, round(sum(pow(0.5, stage) * sign * w), 6) + 0.0 AS v FROM codes JOIN atoms USING (atom) GROUP BY tile, i")
def dictionary_decode(spark, d):
    """Tiles from codes and atoms."""
    return D.decode(_codes(spark, d), _atoms(spark), D.gammas(3)).select("tile", "i", (F.round("v", 6) + 0.0).alias("v"))


@query("dictionary_product", f"WITH {_ATOMS_SQL}, {_CODES_SQL} SELECT tile, round(sum(pow(0.5, stage) * sign * w * (i + 1) / 64), 6) + 0.0 AS y FROM codes JOIN atoms USING (atom) GROUP BY tile")
def dictionary_product(spark, d):
    """Coded tiles times a vector, through the atoms' products."""
    x = spark.range(64).select(F.col("id").alias("i"), ((F.col("id") + 1) / 64).alias("h"))
    return D.fused_product(_codes(spark, d), _atoms(spark), x, D.gammas(3)).select("tile", (F.round("y", 6) + 0.0).alias("y"))


@query("coded_tensor_product", f"""
    WITH {_ATOMS_SQL}, {_CODES_SQL}, t AS (SELECT 'tensor-' || tile % 4 AS name, sum(pow(0.5, stage) * sign * w * (i + 1) / 64) AS y FROM codes JOIN atoms USING (atom) GROUP BY tile)
    SELECT name, count(*) AS tiles, CAST(12 * count(*) AS BIGINT) AS coded_bytes, round(sum(y), 5) + 0.0 AS y FROM t GROUP BY name""")
def coded_tensor_product(spark, d):
    """Tensors whose codes were packed into a number each and out again, times a vector."""
    tiles = coded.packed(_codes(spark, d).withColumns({"name": F.concat(F.lit("tensor-"), F.col("tile") % 4), "dictionary": F.lit("shared")}))
    sizes = tiles.groupBy("name").agg(F.count(F.lit(1)).alias("tiles"), F.sum(2 * F.size("codes")).alias("coded_bytes"))
    x = spark.range(64).select(F.col("id").alias("i"), ((F.col("id") + 1) / 64).alias("h"))
    y = D.fused_product(coded.unpacked(tiles), _atoms(spark), x, D.gammas(3)).groupBy(F.concat(F.lit("tensor-"), F.col("tile") % 4).alias("name")).agg((F.round(F.sum("y"), 5) + 0.0).alias("y"))
    return sizes.join(y, "name")


@query("pursuit_step", f"""WITH {_LONG}, {_ATOMS_SQL}, p AS (SELECT vec_id AS tile, atom, round(sum(v * w), 8) AS p FROM v JOIN atoms ON atoms.i = v.i GROUP BY vec_id, atom)
    SELECT tile, atom, CASE WHEN p < 0 THEN -1 ELSE 1 END AS sign, round(abs(p), 6) AS strength FROM p QUALIFY row_number() OVER (PARTITION BY tile ORDER BY abs(p) DESC, atom) = 1""")
def pursuit_step(spark, d):
    """One step of the greedy pursuit: the atom with the largest product."""
    v = long_vectors(spark, d)
    p = v.join(F.broadcast(_atoms(spark)), "i").groupBy(F.col("vec_id").alias("tile"), "atom").agg(F.round(F.sum(F.col("v") * F.col("w")), 8).alias("p"))
    best = p.groupBy("tile").agg(F.max(F.struct(F.abs("p").alias("s"), (-F.col("atom")).alias("n"), "p")).alias("b"))
    return best.select("tile", (-F.col("b.n")).alias("atom"), F.when(F.col("b.p") < 0, -1).otherwise(1).alias("sign"), F.round("b.s", 6).alias("strength"))


@query("dictionary_fit")
def dictionary_fit(spark, d):
    """Fits a dictionary to the vectors, codes all of them and measures the reconstruction (iterative; tested on its error)."""
    x = vectors(spark, d).select(F.col("vec_id").alias("tile"), "x")
    scales = D.gammas(3)
    atoms = D.fit(x, 64, scales, 5, 6)
    flat = [(a, i, float(w)) for a, row in enumerate(atoms) for i, w in enumerate(row)]
    table_of = spark.createDataFrame(flat, "atom int, i long, w double") if flat else spark.createDataFrame([], "atom int, i long, w double")
    back = D.decode(D.encode(x, atoms, scales, 5), table_of, scales)
    truth = long_vectors(spark, d).select(F.col("vec_id").alias("tile"), "label", "i", F.col("v").alias("t"))
    e = truth.join(back, ["tile", "i"], "left").withColumn("e", F.col("t") - F.coalesce("v", F.lit(0.0)))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("e") * F.col("e")) / F.greatest(F.var_pop("t"), F.lit(1e-12))).alias("nmse"))


@query("reservoir_sample", "SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 2654435761) % 4294967296, vec_id) AS r FROM embeddings) WHERE r <= 20")
def reservoir_sample(spark, d):
    """A bounded, reproducible sample of each label's rows for fitting (a sampling operator)."""
    order = F.struct(((F.col("vec_id") * F.lit(2654435761)) % F.lit(4294967296)).alias("h"), "vec_id")
    from pyspark.sql import Window as W

    r = F.row_number().over(W.partitionBy("label").orderBy(order))
    return table(spark, d, "embeddings").select("label", "vec_id", r.alias("r")).filter("r <= 20").select("label", "vec_id")


@query("dictionary_bytes", "SELECT label, 256 * 64 * 4 + count(*) * 3 * 5 * 2 AS bytes, round(count(*) * 64 * 4 / (256 * 64 * 4 + count(*) * 3 * 5 * 2)::DOUBLE, 6) AS ratio FROM embeddings GROUP BY label")
def dictionary_bytes(spark, d):
    """Bytes of a dictionary and its codes by label."""
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    size = 256 * 64 * 4 + F.col("n") * 3 * 5 * 2
    return n.select("label", size.alias("bytes"), F.round(F.col("n") * 64 * 4 / size, 6).alias("ratio"))


@query("error_metrics", f"""WITH {_LONG}, e AS (SELECT label, v, floor(v * 8) / 8 AS a FROM v)
    SELECT label, round(avg((v - a) * (v - a)), 8) AS mse, round(avg(abs(v - a)), 8) AS mae, round(max(abs(v - a)), 8) AS worst, round(sqrt(avg((v - a) * (v - a))) / sqrt(avg(v * v)), 8) AS relative,
           round(avg((v - a) * (v - a)) / greatest(var_pop(v), 1e-12), 8) AS nmse, count(*) FILTER (a = 0) AS zeros FROM e GROUP BY label""")
def error_metrics(spark, d):
    """Errors of values cut to eighths, by label."""
    v, a = F.col("v"), F.floor(F.col("v") * 8) / 8
    e = v - a
    r = lambda c, n: F.round(c, 8).alias(n)
    return long_vectors(spark, d).groupBy("label").agg(
        r(F.avg(e * e), "mse"), r(F.avg(F.abs(e)), "mae"), r(F.max(F.abs(e)), "worst"), r(F.sqrt(F.avg(e * e)) / F.sqrt(F.avg(v * v)), "relative"),
        r(F.avg(e * e) / F.greatest(F.var_pop(v), F.lit(1e-12)), "nmse"), F.count(F.when(a == 0, 1)).alias("zeros"),
    )


@query("series_summary", """
    SELECT event_type, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def series_summary(spark, d):
    """Count, extremes, mean and interpolated percentiles."""
    v = "value"
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.min(v), "least"), r(F.max(v), "most"), r(F.avg(v), "mean"), r(F.percentile(v, 0.5), "p50"), r(F.percentile(v, 0.95), "p95"))


@query("throughput", "SELECT user_id % 10 AS worker, round(sum(value) / nullif(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6, 0), 8) AS rate, round(100 * (1 - count(*) / sum(value)), 6) AS reduction FROM events GROUP BY 1")
def throughput(spark, d):
    """Amount per second, null where no time passed, and size reduction in percent."""
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("worker")).agg(F.round(F.sum("value") / F.nullif(seconds, F.lit(0.0)), 8).alias("rate"), F.round(100 * (1 - F.count(F.lit(1)) / F.sum("value")), 6).alias("reduction"))


@query("flop_counts", """
    WITH p AS (SELECT DISTINCT p_size AS k, code, CAST(p_size * 128 AS BIGINT) AS input_dim, CAST(p_size * 256 AS BIGINT) AS output_dim FROM part, (SELECT unnest(['binary', 'real', 'hybrid']) AS code)),
    f AS (SELECT *, 2 * 512 * input_dim AS precompute, CASE WHEN code = 'binary' THEN k ELSE 2 * k END * (input_dim // 128) * (output_dim // 128) AS gather, greatest(1, k // 2) AS rr FROM p)
    SELECT k, code, 2 * output_dim * input_dim AS dense, precompute, gather, CASE WHEN code = 'hybrid' THEN 2 * rr * input_dim + 2 * output_dim * rr ELSE 0 END AS residual, precompute + gather + CASE WHEN code = 'hybrid' THEN 2 * rr * input_dim + 2 * output_dim * rr ELSE 0 END AS total FROM f""")
def flop_counts(spark, d):
    """Operations of a dense product and of one through dictionary codes, by kind of code."""
    p = table(spark, d, "part").select(F.col("p_size").alias("k"), F.explode(F.array(*map(F.lit, ("binary", "real", "hybrid")))).alias("code")).distinct()
    k, i, o = F.col("k"), F.col("k").cast("long") * 128, F.col("k").cast("long") * 256
    gather = F.when(F.col("code") == "binary", k).otherwise(2 * k) * F.floor(i / 128) * F.floor(o / 128)
    rank = F.greatest(F.lit(1), F.floor(k / 2))
    residual = F.when(F.col("code") == "hybrid", 2 * rank * i + 2 * o * rank).otherwise(0)
    return p.select("k", "code", (2 * o * i).alias("dense"), (2 * 512 * i).alias("precompute"), gather.alias("gather"), residual.alias("residual"), (2 * 512 * i + gather + residual).alias("total"))


@query("storage_ratio", """
    WITH p AS (SELECT DISTINCT p_size AS k, code FROM part, (SELECT unnest(['binary', 'real', 'hybrid']) AS code)),
    b AS (SELECT *, (k * 9 + 7) // 8 + CASE code WHEN 'binary' THEN 0 WHEN 'real' THEN k * 4 ELSE (k // 2) * 2 END AS tile_bytes FROM p)
    SELECT k, code, CAST(tile_bytes AS BIGINT) AS tile_bytes, CAST(512 * 128 * 4 + tile_bytes * 4096 AS BIGINT) AS encoded_bytes, round(4194304 * 4 / (512 * 128 * 4 + tile_bytes * 4096)::DOUBLE, 6) AS ratio FROM b""")
def storage_ratio(spark, d):
    """Bytes of codes with 512 atoms of 128 entries (nine bits an index) for 4,096 tiles."""
    p = table(spark, d, "part").select(F.col("p_size").cast("long").alias("k"), F.explode(F.array(*map(F.lit, ("binary", "real", "hybrid")))).alias("code")).distinct()
    k = F.col("k")
    tile = F.floor((k * 9 + 7) / 8) + F.when(F.col("code") == "binary", 0).when(F.col("code") == "real", k * 4).otherwise(F.floor(k / 2) * 2)
    total = 512 * 128 * 4 + tile * 4096
    return p.select(F.col("k").cast("int").alias("k"), "code", tile.cast("long").alias("tile_bytes"), total.cast("long").alias("encoded_bytes"), F.round(4194304 * 4 / total, 6).alias("ratio"))


@query("storage_by_role", f"""WITH {_NAMES}, r AS (SELECT *, CASE WHEN contains(lower(name), 'mlp') OR contains(lower(name), 'ffn') THEN 'mlp' ELSE 'other' END AS role FROM n),
    s AS (SELECT role, (p_size * 64 // 128) * (p_size * 32 // 128) AS tiles, p_size * 64 * p_size * 32 AS numel FROM r)
    SELECT role, count(*) AS tensors, CAST(sum(tiles) AS BIGINT) AS tiles, CAST(sum(tiles * CASE WHEN role = 'mlp' THEN (24 * 10 + 7) // 8 ELSE (15 * 9 + 7) // 8 END) AS BIGINT) AS code_bytes, CAST(sum((numel - tiles * 16384) * 2) AS BIGINT) AS edge_bytes FROM s GROUP BY role""")
def storage_by_role(spark, d):
    """Tiles of 128 x 128, bytes of their codes and of the edges kept in half precision, by role."""
    role = F.when(M.has_any(F.lower("name"), ("mlp", "ffn")), "mlp").otherwise("other")
    rows, cols = F.col("p_size").cast("long") * 64, F.col("p_size").cast("long") * 32
    s = _names(spark, d).select(role.alias("role"), (F.floor(rows / 128) * F.floor(cols / 128)).alias("tiles"), (rows * cols).alias("numel"))
    each = F.when(F.col("role") == "mlp", (24 * 10 + 7) // 8).otherwise((15 * 9 + 7) // 8)
    return s.groupBy("role").agg(F.count(F.lit(1)).alias("tensors"), F.sum("tiles").alias("tiles"), F.sum(F.col("tiles") * each).cast("long").alias("code_bytes"), F.sum((F.col("numel") - F.col("tiles") * 16384) * 2).alias("edge_bytes"))


@query("half_precision_bits", f"WITH {_LONG}, q AS (SELECT vec_id, i, floor(v * 16) / 16 AS h FROM v) SELECT vec_id, count(*) AS n, round(sum(h), 6) + 0.0 AS total FROM q GROUP BY vec_id")
def half_precision_bits(spark, d):
    """Values that half precision holds exactly survive a trip through its 16 bits."""
    from bitloom.functions.bits import from_half, to_half

    h = long_vectors(spark, d).select("vec_id", from_half(to_half(F.floor(F.col("v") * 16) / 16)).alias("h"))
    return h.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("h"), 6) + 0.0).alias("total"))


@query("block_sizes", """
    WITH t(name, block, bytes) AS (VALUES ('f32', 1, 4), ('f16', 1, 2), ('bf16', 1, 2), ('i8', 1, 1), ('q4_0', 32, 18), ('q8_0', 32, 34), ('q4_k', 256, 144), ('q5_k', 256, 176), ('q6_k', 256, 210))
    SELECT p_size AS k, name, CAST((p_size * 100 + block - 1) // block * bytes AS BIGINT) AS size FROM (SELECT DISTINCT p_size FROM part), t""")
def block_sizes(spark, d):
    """Bytes of tensors in block formats."""
    from bitloom.functions.bits import BLOCK_FORMATS

    formats = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(b).alias("block"), F.lit(s).alias("bytes")) for n, (b, s) in BLOCK_FORMATS.items()))
    p = table(spark, d, "part").select("p_size").distinct().select(F.col("p_size").alias("k"), F.explode(formats).alias("f"))
    return p.select("k", "f.name", (F.ceil(F.col("k") * 100 / F.col("f.block")) * F.col("f.bytes")).cast("long").alias("size"))


@query("quant_storage", f"WITH {_LONG} SELECT label, count(*) * 4 AS full_bytes, count(*) + count(DISTINCT vec_id) * 4 AS eight_bit, count(*) // 2 + count(DISTINCT vec_id) * 4 * 5 AS four_bit FROM v GROUP BY label")
def quant_storage(spark, d):
    """Bytes of vectors, of 8-bit codes with a scale, and of grouped 4-bit codes."""
    n = C.packed(spark, d).groupBy("label").agg(F.sum(F.size("x")).alias("n"), F.count(F.lit(1)).alias("r"))
    return n.select("label", (F.col("n") * 4).alias("full_bytes"), (F.col("n") + F.col("r") * 4).alias("eight_bit"), (F.floor(F.col("n") / 2) + F.col("r") * 20).alias("four_bit"))


@query("part_patterns", r"""
    WITH f AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'net' || p_size % 4 || '-0000' || (p_partkey % 4 + 1) || '-of-00004.gguf' WHEN 1 THEN 'net' || p_size % 4 || '.gguf.0000' || (p_partkey % 5 + 1) ELSE 'net' || p_size % 4 || '_part' || (p_partkey % 6 + 1) || '.onnx' END AS file FROM part),
    m AS (SELECT DISTINCT CASE WHEN regexp_matches(file, '^.+-[0-9]+-of-[0-9]+\.[^.]+$') THEN regexp_extract(file, '^(.+)-[0-9]+-of-', 1) WHEN regexp_matches(file, '^.+\.[0-9]+$') THEN regexp_extract(file, '^(.+)\.[0-9]+$', 1) ELSE regexp_extract(file, '^(.+)_part[0-9]+', 1) END AS base,
        CASE WHEN regexp_matches(file, '^.+-[0-9]+-of-[0-9]+\.[^.]+$') THEN 'of' WHEN regexp_matches(file, '^.+\.[0-9]+$') THEN 'suffix' ELSE 'part' END AS pattern,
        CAST(CASE WHEN regexp_matches(file, '^.+-[0-9]+-of-[0-9]+\.[^.]+$') THEN regexp_extract(file, '-([0-9]+)-of-', 1) WHEN regexp_matches(file, '^.+\.[0-9]+$') THEN regexp_extract(file, '\.([0-9]+)$', 1) ELSE regexp_extract(file, '_part([0-9]+)', 1) END AS BIGINT) AS number FROM f)
    SELECT base, pattern, count(*) AS parts, count(*) = max(number) AND min(number) = 1 AS gapless FROM m GROUP BY base, pattern""")
def part_patterns(spark, d):
    """Models in parts by each of three ways of naming, and whether their numbers have no gaps."""
    k, s = F.col("p_partkey"), F.concat(F.lit("net"), F.col("p_size") % 4)
    file = F.when(k % 3 == 0, F.concat(s, F.lit("-0000"), k % 4 + 1, F.lit("-of-00004.gguf"))).when(k % 3 == 1, F.concat(s, F.lit(".gguf.0000"), k % 5 + 1)).otherwise(F.concat(s, F.lit("_part"), k % 6 + 1, F.lit(".onnx")))
    m = table(spark, d, "part").select(M.file_part(file).alias("m")).select("m.*").distinct()
    return m.groupBy("base", "pattern").agg(F.count(F.lit(1)).alias("parts"), ((F.count(F.lit(1)) == F.max("number")) & (F.min("number") == 1)).alias("gapless"))


@query("code_errors", f"""
    WITH {_LONG}, a AS (SELECT CAST(unnest(range(64)) AS BIGINT) AS a), c AS (SELECT vec_id, a, sum(v * (1 - 2 * (bit_count(i & a) % 2))) / 8.0::DOUBLE AS c FROM v, a GROUP BY vec_id, a),
    p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(round(c, 10)) DESC, a) <= 4 AS used FROM c),
    r AS (SELECT *, CASE WHEN used THEN c - sign(c) ELSE c END AS rest FROM p),
    h AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(round(rest, 10)) DESC, a) <= 2 AS again FROM r)
    SELECT vec_id AS tile, round(sum(CASE WHEN used THEN 0 ELSE c * c END) / sum(c * c), 6) + 0.0 AS "real", round(sum(rest * rest) / sum(c * c), 6) + 0.0 AS "binary", round(sum(CASE WHEN again THEN 0 ELSE rest * rest END) / sum(c * c), 6) + 0.0 AS hybrid
    FROM h GROUP BY vec_id""")
def code_errors(spark, d):
    """Errors of real, sign-only and two-step codes of vectors over the Walsh dictionary, four atoms a vector."""
    e = D.code_errors(vectors(spark, d).select(F.col("vec_id").alias("tile"), "x"), D.walsh(64), 4)
    return e.select("tile", *((F.round(c, 6) + 0.0).alias(c) for c in ("real", "binary", "hybrid")))
