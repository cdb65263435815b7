"""Queries of the tensor kernels and layer operators over the embeddings table (rows of 64, or 8 x 8 images)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.functions.base import let, total
from bitloom.operators import tensors as X
from bitloom.plans.registry import query
from bitloom.sources.tables import long_vectors, table, vectors

_LONG = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i FROM embeddings)"


def _out(df, x, *keys, digits=6):
    """keys, i, v of an array column."""
    return df.select(*keys, F.posexplode(x).alias("i", "v")).select(*keys, F.col("i").cast("long").alias("i"), (F.round("v", digits) + 0.0).alias("v"))


_ACTIVATION_SQL = {
    "relu": "greatest(v, 0.0)", "leaky_relu": "CASE WHEN v > 0 THEN v ELSE 0.01::DOUBLE * v END", "gelu": "0.5 * v * (1 + tanh(0.7978845608028654::DOUBLE * (v + 0.044715::DOUBLE * v * v * v)))",
    "sigmoid": "1 / (1 + exp(-v))", "tanh": "tanh(v)", "silu": "v / (1 + exp(-v))", "elu": "CASE WHEN v >= 0 THEN v ELSE exp(v) - 1 END",
}


def _activation(name):
    @query(f"act_{name}", f"WITH {_LONG} SELECT vec_id, i, round({_ACTIVATION_SQL[name]}, 6) + 0.0 AS v FROM v")
    def build(spark, d):
        return _out(vectors(spark, d), F.transform("x", lambda v: X.activation(name, v)), "vec_id")

    build.__doc__ = f"The activation {name} of every entry."


for _name in _ACTIVATION_SQL:
    _activation(_name)


@query("softmax_vec", f"WITH {_LONG}, e AS (SELECT vec_id, i, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM v) SELECT vec_id, i, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS v FROM e")
def softmax_vec(spark, d):
    """Softmax of each vector."""
    return _out(vectors(spark, d), X.softmax(F.col("x")), "vec_id")


@query("layer_norm", f"WITH {_LONG} SELECT vec_id, i, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 5) + 0.0 AS v FROM v WINDOW w AS (PARTITION BY vec_id)")
def layer_norm(spark, d):
    return _out(vectors(spark, d), X.layer_norm(F.col("x")), "vec_id", digits=5)


@query("rms_norm", f"WITH {_LONG} SELECT vec_id, i, round(v / sqrt(avg(v * v) OVER (PARTITION BY vec_id) + 1e-5), 5) + 0.0 AS v FROM v")
def rms_norm(spark, d):
    return _out(vectors(spark, d), X.rms_norm(F.col("x")), "vec_id", digits=5)


@query("batch_norm", f"WITH {_LONG}, s AS (SELECT i, avg(v) AS m, var_pop(v) AS s FROM v GROUP BY i) SELECT vec_id, v.i, round((v - m) / sqrt(s + 1e-5), 5) + 0.0 AS v FROM v JOIN s ON s.i = v.i")
def batch_norm(spark, d):
    """Normalised by each dimension's mean and variance; the statistics are one row a dimension."""
    v = long_vectors(spark, d)
    s = v.groupBy("i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    return v.join(s, "i").select("vec_id", "i", (F.round((F.col("v") - F.col("m")) / F.sqrt(F.col("s") + 1e-5), 5) + 0.0).alias("v"))


@query("batch_norm_running", f"WITH {_LONG} SELECT label, i, round(0.1::DOUBLE * avg(v), 6) + 0.0 AS running_mean, round(0.9::DOUBLE + 0.1::DOUBLE * var_pop(v), 6) AS running_var FROM v GROUP BY ALL")
def batch_norm_running(spark, d):
    """Running statistics after one batch (a label's rows), momentum 0.1 from mean 0 and variance 1."""
    return long_vectors(spark, d).groupBy("label", "i").agg((F.round(0.1 * F.avg("v"), 6) + 0.0).alias("running_mean"), F.round(0.9 + 0.1 * F.var_pop("v"), 6).alias("running_var"))


@query("fused_norm_relu", f"WITH {_LONG}, s AS (SELECT i, avg(v) AS m, var_pop(v) AS s FROM v GROUP BY i) SELECT vec_id, v.i, round(greatest(0.0, (v - m) / sqrt(s + 1e-5)), 5) + 0.0 AS v FROM v JOIN s ON s.i = v.i")
def fused_norm_relu(spark, d):
    """Batch norm and ReLU in one projection."""
    return batch_norm(spark, d).select("vec_id", "i", (F.greatest(F.lit(0.0), "v") + 0.0).alias("v"))


@query("residual_layer_norm", f"WITH {_LONG}, r AS (SELECT vec_id, i, v + greatest(v, 0.0) AS v FROM v) SELECT vec_id, i, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 5) + 0.0 AS v FROM r WINDOW w AS (PARTITION BY vec_id)")
def residual_layer_norm(spark, d):
    """A vector plus its activation, normalised."""
    added = vectors(spark, d).withColumn("x", F.transform("x", lambda v: v + X.relu(v)))
    return _out(added, X.layer_norm(F.col("x")), "vec_id", digits=5)


_W = "(((i * 7 + j * 3) % 11) - 5) / 11.0::DOUBLE"


def _linear(x, outputs=8):
    """Products with the fixed 64 x outputs weight matrix."""
    return F.transform(F.sequence(F.lit(0), F.lit(outputs - 1)), lambda j: total(F.transform(x, lambda v, i: v * ((((i * 7 + j * 3) % 11) - 5) / F.lit(11.0)))))


def _linear_sql(outer):
    return f"WITH {_LONG}, y AS (SELECT vec_id, CAST(j AS BIGINT) AS i, sum(v * {_W}) AS y FROM v, (SELECT unnest(range(8)) AS j) GROUP BY vec_id, j) SELECT vec_id, i, round({outer}, 6) + 0.0 AS v FROM y"


@query("linear", _linear_sql("y + i * 0.1::DOUBLE"))
def linear(spark, d):
    """Linear layer with a bias: the weights are a rule, so each row is computed on its own."""
    return _out(vectors(spark, d), F.transform(_linear(F.col("x")), lambda y, j: y + j * 0.1), "vec_id")


@query("linear_relu", _linear_sql("greatest(0.0, y + i * 0.1::DOUBLE)"))
def linear_relu(spark, d):
    return _out(vectors(spark, d), F.transform(_linear(F.col("x")), lambda y, j: X.relu(y + j * 0.1)), "vec_id")


@query("linear_gelu", _linear_sql("0.5 * y * (1 + tanh(0.7978845608028654::DOUBLE * (y + 0.044715::DOUBLE * y * y * y)))"))
def linear_gelu(spark, d):
    return _out(vectors(spark, d), F.transform(_linear(F.col("x")), X.gelu), "vec_id")


@query("axpby", f"WITH {_LONG} SELECT a.vec_id, a.i, round(2.0 * a.v - 0.5 * b.v, 6) + 0.0 AS v FROM v a JOIN v b ON b.vec_id = a.vec_id AND b.i = 63 - a.i")
def axpby(spark, d):
    """Twice a vector less half of its reversal."""
    return _out(vectors(spark, d), F.zip_with("x", F.reverse("x"), lambda a, b: 2.0 * a - 0.5 * b), "vec_id")


@query("elementwise", f"""WITH {_LONG}, w AS (SELECT vec_id, i, v, (i % 5) * 0.25::DOUBLE AS w FROM v)
    SELECT vec_id, i, round(v + w, 6) + 0.0 AS added, round(v - w, 6) + 0.0 AS subtracted, round(v * w, 6) + 0.0 AS multiplied, round(CASE WHEN abs(w) > 1e-8 THEN v / w ELSE v END, 6) + 0.0 AS divided FROM w""")
def elementwise(spark, d):
    """Addition, subtraction, multiplication and division by weights; division leaves entries alone where the weight is tiny."""
    v, w = F.col("v"), (F.col("i") % 5) * 0.25
    r = lambda c, n: (F.round(c, 6) + 0.0).alias(n)
    return long_vectors(spark, d).select("vec_id", "i", r(v + w, "added"), r(v - w, "subtracted"), r(v * w, "multiplied"), r(F.when(F.abs(w) > 1e-8, v / F.nullif(w, F.lit(0.0))).otherwise(v), "divided"))


@query("matvec", f"WITH {_LONG} SELECT vec_id, round(sum(v * (i + 1) / 64.0::DOUBLE), 6) AS y FROM v GROUP BY vec_id")
def matvec(spark, d):
    """Rows times a fixed vector."""
    return vectors(spark, d).select("vec_id", F.round(total(F.transform("x", lambda v, i: v * (i + 1) / F.lit(64.0))), 6).alias("y"))


@query("gemm_gram", f"WITH {_LONG} SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM v a JOIN v b USING (vec_id) GROUP BY a.i, b.i")
def gemm_gram(spark, d):
    """Products of all dimensions, summed over all rows."""
    return X.gram(vectors(spark, d), 64).select("i", "j", (F.round("v", 4) + 0.0).alias("v"))


@query("gemm_scaled", f"""WITH {_LONG}, l AS (SELECT label, i, sum(v) AS v FROM v GROUP BY ALL)
    SELECT a.label AS i, b.label AS j, round(0.5 * sum(a.v * b.v) + 2.0 * (a.label + b.label), 4) + 0.0 AS v FROM l a JOIN l b ON a.i = b.i GROUP BY a.label, b.label""")
def gemm_scaled(spark, d):
    """alpha A B^T + beta C over the summed rows of each label, as a join of long matrices."""
    m = long_vectors(spark, d).groupBy("label", "i").agg(F.sum("v").alias("v"))
    a, b = m.select(F.col("label").alias("i"), F.col("i").alias("k"), "v"), m.select(F.col("i").alias("k"), F.col("label").alias("j"), "v")
    return X.matmul(a, b).select("i", "j", (F.round(0.5 * F.col("v") + 2.0 * (F.col("i") + F.col("j")), 4) + 0.0).alias("v"))


_COO = "c AS (SELECT l_orderkey % 997 AS row, l_partkey % 64 AS col, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY ALL)"


def _coo(spark, d):
    """A sparse 997 x 64 matrix of revenue."""
    x = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 997).alias("row"), (F.col("l_partkey") % 64).alias("col")).agg(F.sum(x).alias("v"))


@query("sparse_gemv", f"WITH {_COO} SELECT row, round(sum(v * (col + 1) / 64.0::DOUBLE), 2) AS y FROM c GROUP BY row")
def sparse_gemv(spark, d):
    """Sparse rows times a fixed vector."""
    return _coo(spark, d).groupBy("row").agg(F.round(F.sum(F.col("v") * (F.col("col") + 1) / F.lit(64.0)), 2).alias("y"))


@query("csr_row_ptr", f"WITH {_COO}, n AS (SELECT r AS row, count(v) AS entries FROM (SELECT unnest(range(1000)) AS r) LEFT JOIN c ON c.row = r GROUP BY r) SELECT row, CAST(sum(entries) OVER (ORDER BY row) - entries AS BIGINT) AS start, entries FROM n")
def csr_row_ptr(spark, d):
    """Row starts and lengths of a compressed sparse matrix, empty rows included."""
    return X.csr_row_pointers(_coo(spark, d), 1000)


@query("sparse_linear", f"""WITH {_LONG}, top AS (SELECT vec_id, i, v FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) <= 16)
    SELECT vec_id, i // 8 AS row, round(sum(v * ((i % 8) + 1)) + (i // 8) * 0.5::DOUBLE, 6) AS y FROM top GROUP BY vec_id, i // 8""")
def sparse_linear(spark, d):
    """Flat indices of kept weights as (row, column) of an 8 x 8 layer, with a bias for each row that is reached."""
    from bitloom.operators.codecs import top_k

    kept = top_k(vectors(spark, d), F.lit(16)).select("vec_id", F.explode("kept").alias("e"))
    kept = kept.select("vec_id", F.floor(F.col("e.i") / 8).cast("long").alias("row"), (F.col("e.v") * ((F.col("e.i") % 8) + 1)).alias("p"))
    return kept.groupBy("vec_id", "row").agg(F.sum("p").alias("s")).select("vec_id", "row", F.round(F.col("s") + F.col("row") * 0.5, 6).alias("y"))


@query("block_matvec", f"""WITH {_LONG} SELECT vec_id, i // 32 AS block_row, (i % 8) // 4 AS block_col, round(sum(v * ((i % 4) + 1)), 6) AS y FROM v GROUP BY ALL""")
def block_matvec(spark, d):
    """Products of the 4 x 4 blocks of 8 x 8 matrices with a vector, by block."""
    i = F.col("i")
    return long_vectors(spark, d).groupBy("vec_id", F.floor(i / 32).cast("long").alias("block_row"), F.floor((i % 8) / 4).cast("long").alias("block_col")).agg(F.round(F.sum(F.col("v") * ((i % 4) + 1)), 6).alias("y"))


def _pool(name, kind, agg):
    @query(name, f"WITH {_LONG} SELECT vec_id, (i // 16) * 4 + (i % 8) // 2 AS i, round({agg}(v), 6) + 0.0 AS v FROM v GROUP BY vec_id, (i // 16) * 4 + (i % 8) // 2")
    def build(spark, d):
        return _out(vectors(spark, d), X.pool(F.col("x"), 8, kind), "vec_id")

    build.__doc__ = f"2 x 2 {kind} pooling of 8 x 8 images."


_pool("maxpool2x2", "max", "max")
_pool("avgpool2x2", "avg", "avg")



@query("global_avgpool", f"WITH {_LONG} SELECT vec_id, i // 16 AS channel, round(avg(v), 6) + 0.0 AS v FROM v GROUP BY ALL")
def global_avgpool(spark, d):
    """The mean of each of four 4 x 4 channels."""
    means = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: total(F.slice("x", c * 16 + 1, F.lit(16))) / 16)
    return vectors(spark, d).select("vec_id", F.posexplode(means).alias("channel", "v")).select("vec_id", F.col("channel").cast("long").alias("channel"), (F.round("v", 6) + 0.0).alias("v"))


_EDGE = [[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]]
_SOBEL = [[-1.0, 0.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, 0.0, 1.0]]
_kernel_sql = lambda k: ", ".join(f"({a}, {b}, {k[a][b]}::DOUBLE)" for a in range(3) for b in range(3))


@query("conv3x3", f"""WITH {_LONG}, k(a, b, w) AS (VALUES {_kernel_sql(_EDGE)}), o AS (SELECT CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS z))
    SELECT vec_id, y * 8 + z AS i, round(sum(v * w), 6) + 0.0 AS v FROM o, k, v WHERE v.i // 8 = y + a - 1 AND v.i % 8 = z + b - 1 GROUP BY vec_id, y, z""")
def conv3x3(spark, d):
    """Same-size convolution with zeros outside."""
    return _out(vectors(spark, d), X.conv2d(F.col("x"), 8, _EDGE, padding=1), "vec_id")


@query("conv3x3_stride2", f"""WITH {_LONG}, k(a, b, w) AS (VALUES {_kernel_sql(_SOBEL)}), o AS (SELECT CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM (SELECT unnest(range(3)) AS y), (SELECT unnest(range(3)) AS z))
    SELECT vec_id, y * 3 + z AS i, round(sum(v * w), 6) + 0.0 AS v FROM o, k, v WHERE v.i // 8 = 2 * y + a AND v.i % 8 = 2 * z + b GROUP BY vec_id, y, z""")
def conv3x3_stride2(spark, d):
    """Convolution without padding at stride 2."""
    return _out(vectors(spark, d), X.conv2d(F.col("x"), 8, _SOBEL, stride=2), "vec_id")


@query("conv_transpose", f"""WITH {_LONG}, k(a, b, w) AS (VALUES {_kernel_sql(_SOBEL)})
    SELECT vec_id, (2 * (i // 8) + a) * 17 + 2 * (i % 8) + b AS i, round(sum(v * w), 6) + 0.0 AS v FROM v, k GROUP BY vec_id, (2 * (i // 8) + a) * 17 + 2 * (i % 8) + b""")
def conv_transpose(spark, d):
    """Transposed 3 x 3 convolution at stride 2: 8 x 8 images become 17 x 17."""
    return _out(vectors(spark, d), X.conv_transpose2d(F.col("x"), 8, _SOBEL, stride=2), "vec_id")


def _channels(n):
    """(vec_id, channel, x): the 64 entries as n images."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.struct(c.alias("channel"), F.slice("x", c * (64 // n) + 1, F.lit(64 // n)).alias("x")))


@query("depthwise_conv", f"""WITH {_LONG}, k(a, b, w) AS (VALUES {_kernel_sql(_EDGE)}), o AS (SELECT CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS z))
    SELECT vec_id, i // 16 AS channel, y * 4 + z AS i, round(sum(v * w * (i // 16 + 1)), 6) + 0.0 AS v FROM o, k, v WHERE (v.i % 16) // 4 = y + a - 1 AND v.i % 4 = z + b - 1 GROUP BY vec_id, i // 16, y, z""")
def depthwise_conv(spark, d):
    """Four 4 x 4 channels, each with its own multiple of a kernel."""
    c = vectors(spark, d).select("vec_id", F.explode(_channels(4)).alias("c")).select("vec_id", F.col("c.channel").cast("long").alias("channel"), F.col("c.x").alias("x"))
    return _out(c, let(F.col("channel") + 1, lambda m: F.transform(X.conv2d(F.col("x"), 4, _EDGE, padding=1), lambda v: v * m)), "vec_id", "channel")


@query("pointwise_conv", f"WITH {_LONG} SELECT vec_id, CAST(o AS BIGINT) AS channel, i % 16 AS i, round(sum(v * (((i // 16) + 2 * o) % 3 - 1)), 6) + 0.0 AS v FROM v, (SELECT unnest(range(2)) AS o) GROUP BY vec_id, o, i % 16")
def pointwise_conv(spark, d):
    """1 x 1 convolution of four channels into two."""
    out = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda o: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.struct(
        o.cast("long").alias("channel"), p.cast("long").alias("i"), F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda a, c: a + F.get("x", c * 16 + p) * ((c + 2 * o) % 3 - 1)).alias("v")))))
    return vectors(spark, d).select("vec_id", F.explode(out).alias("o")).select("vec_id", "o.channel", "o.i", (F.round("o.v", 6) + 0.0).alias("v"))


@query("grouped_conv", f"WITH {_LONG} SELECT vec_id, i // 32 AS grp, i % 16 AS i, round(sum(v * ((i // 16) % 2 + 1)), 6) + 0.0 AS v FROM v GROUP BY vec_id, i // 32, i % 16")
def grouped_conv(spark, d):
    """Two groups of two channels, each group summed with weights of its own (1 x 1)."""
    i = F.col("i")
    each = long_vectors(spark, d).groupBy("vec_id", F.floor(i / 32).cast("long").alias("grp"), (i % 16).alias("p"))
    return each.agg((F.round(F.sum(F.col("v") * (F.floor(i / 16) % 2 + 1)), 6) + 0.0).alias("v")).withColumnRenamed("p", "i")


@query("im2col", f"""WITH {_LONG}, o AS (SELECT unnest(range(36)) AS o), k AS (SELECT unnest(range(9)) AS k)
    SELECT vec_id, CAST(o AS BIGINT) AS patch, CAST(k AS BIGINT) AS k, round(v, 6) + 0.0 AS v FROM o, k, v WHERE v.i = (o // 6 + k // 3) * 8 + o % 6 + k % 3""")
def im2col(spark, d):
    """The 3 x 3 windows of 8 x 8 images."""
    p = vectors(spark, d).select("vec_id", F.posexplode(X.im2col(F.col("x"), 8, 3)).alias("patch", "w")).select("vec_id", F.col("patch").cast("long").alias("patch"), F.posexplode("w").alias("k", "v"))
    return p.select("vec_id", "patch", F.col("k").cast("long").alias("k"), (F.round("v", 6) + 0.0).alias("v"))


@query("transpose2d", f"WITH {_LONG} SELECT vec_id, (i % 16) * 4 + i // 16 AS i, round(v, 6) + 0.0 AS v FROM v")
def transpose2d(spark, d):
    """4 x 16 matrices turned over."""
    return _out(vectors(spark, d), X.transpose(F.col("x"), 4, 16), "vec_id")


@query("slice_first", f"WITH {_LONG} SELECT vec_id, i, round(v, 6) + 0.0 AS v FROM v WHERE i < 32")
def slice_first(spark, d):
    """The first half of each vector."""
    return _out(vectors(spark, d), F.slice("x", F.lit(1), F.floor(F.size("x") / 2).cast("int")), "vec_id")


@query("concat", f"WITH {_LONG} SELECT vec_id, i, round(v, 6) + 0.0 AS v FROM v UNION ALL SELECT vec_id, i + 64, round(greatest(v, 0.0), 6) + 0.0 FROM v")
def concat(spark, d):
    """A vector followed by its activation."""
    return _out(vectors(spark, d), F.concat("x", F.transform("x", X.relu)), "vec_id")


@query("dropout_mask", f"WITH {_LONG} SELECT vec_id, i, round(CASE WHEN (vec_id * 2654435761 + i * 40503) % 1000 < 100 THEN 0.0 ELSE v / 0.9::DOUBLE END, 6) + 0.0 AS v FROM v")
def dropout_mask(spark, d):
    """A reproducible mask of a tenth of the entries, the rest scaled up."""
    v = long_vectors(spark, d)
    out = (F.col("vec_id") * F.lit(2654435761) + F.col("i") * 40503) % 1000 < 100
    return v.select("vec_id", "i", (F.round(F.when(out, 0.0).otherwise(F.col("v") / 0.9), 6) + 0.0).alias("v"))


_BLOCKS = "s AS (SELECT vec_id // 16 AS block, vec_id, embedding::DOUBLE[] AS x FROM embeddings)"


def _blocks(spark, d):
    """Sequences of 16 vectors."""
    return vectors(spark, d).select(F.floor(F.col("vec_id") / 16).alias("block"), "vec_id", "x")


def _attention_sql(causal, heads):
    size = 64 // heads
    seen = "AND b.vec_id <= a.vec_id" if causal else ""
    return f"""WITH {_BLOCKS}, h AS (SELECT block, vec_id, CAST(hd AS INT) AS head, x[hd * {size} + 1 : hd * {size} + {size}] AS x FROM s, (SELECT unnest(range({heads})) AS hd)),
        p AS (SELECT a.block, a.vec_id, a.head, b.x, list_dot_product(a.x, b.x) / sqrt({size}) AS s FROM h a JOIN h b ON a.block = b.block AND a.head = b.head {seen}),
        e AS (SELECT *, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS w FROM p WINDOW w AS (PARTITION BY vec_id, head)),
        f AS (SELECT block, vec_id, head, w, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM e)
        SELECT block, vec_id, head, CAST(i AS BIGINT) AS i, round(sum(w * v), 5) + 0.0 AS v FROM f GROUP BY ALL"""


def _attention(name, causal, heads, doc):
    @query(name, _attention_sql(causal, heads))
    def build(spark, d):
        return _out(X.attention(_blocks(spark, d), ["block"], "vec_id", 64, causal, heads), "out", "block", "vec_id", "head", digits=5)

    build.__doc__ = doc


_attention("attention_block", False, 1, "Scaled dot-product attention within blocks of 16 vectors.")
_attention("attention_causal", True, 1, "Attention to the vector itself and those before it.")
_attention("attention_heads", True, 8, "Causal attention with eight heads.")


@query("rope", """
    WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i FROM embeddings),
    p AS (SELECT a.vec_id, a.i, a.v, b.v AS o, (a.vec_id % 32) * pow(1000000.0::DOUBLE, -(2 * (a.i // 2)) / 64.0::DOUBLE) AS t FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.i = CASE WHEN a.i % 2 = 0 THEN a.i + 1 ELSE a.i - 1 END)
    SELECT vec_id, i, round(CASE WHEN i % 2 = 0 THEN v * cos(t) - o * sin(t) ELSE o * sin(t) + v * cos(t) END, 6) + 0.0 AS v FROM p""")
def rope(spark, d):
    """Rotary positions on interleaved pairs."""
    return _out(vectors(spark, d), X.rope(F.col("x"), F.col("vec_id") % 32), "vec_id")


@query("head_layout", """
    SELECT p_partkey, w AS width, CASE WHEN w % 128 = 0 THEN 128 WHEN w % 64 = 0 THEN 64 WHEN w % 256 = 0 THEN 256 WHEN w % 32 = 0 THEN 32 WHEN w % 16 = 0 THEN 16 ELSE w END AS head_dim
    FROM (SELECT p_partkey, CAST(p_size * 8 AS BIGINT) AS w FROM part)""")
def head_layout(spark, d):
    """Width of an attention head inferred from the layer's width."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 8).cast("long").alias("width"))
    return p.select("p_partkey", "width", X.head_size(F.col("width")).cast("long").alias("head_dim"))


@query("repeat_kv", f"WITH {_LONG} SELECT vec_id, CAST(q AS BIGINT) AS q_head, i % 16 AS i, round(v, 6) + 0.0 AS v FROM v, (SELECT unnest(range(8)) AS q) WHERE i // 16 = q // 2")
def repeat_kv(spark, d):
    """Four key heads serve eight query heads."""
    heads = vectors(spark, d).select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("q_head"))
    return _out(heads.withColumn("q_head", F.col("q_head").cast("long")), F.slice("x", F.floor(F.col("q_head") / 2).cast("int") * 16 + 1, F.lit(16)), "vec_id", "q_head")


@query("silu_gate", f"WITH {_LONG} SELECT a.vec_id, a.i, round(a.v / (1 + exp(-a.v)) * b.v, 6) + 0.0 AS v FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.i = a.i + 32")
def silu_gate(spark, d):
    """The first half gates the second."""
    half = lambda k: F.slice("x", k * 32 + 1, 32)
    return _out(vectors(spark, d), F.zip_with(half(0), half(1), lambda a, b: X.silu(a) * b), "vec_id")


_MATRIX = "list_transform(range({n}), lambda i: ((i * {a} + j * {b} + {c}) % 7 - 3) / 16.0::DOUBLE)"


def _project_sql(x, rows, cols, a, b, c):
    """A list of the products of a row with the rows of a rule's matrix."""
    return f"list_transform(range({rows}), lambda j: list_dot_product({x}, {_MATRIX.format(n=cols, a=a, b=b, c=c)}))"


def _rotated_sql(x, n):
    turn = "pos * pow(1000000.0::DOUBLE, -(2 * ((j % 4) // 2)) / 4.0::DOUBLE)"
    return f"list_transform(range({n}), lambda j: CASE WHEN j % 2 = 0 THEN {x}[j + 1] * cos({turn}) - {x}[j + 2] * sin({turn}) ELSE {x}[j] * sin({turn}) + {x}[j + 1] * cos({turn}) END)"


_NORM_SQL = "list_transform(range(16), lambda j: {0}[j + 1] / sqrt(list_dot_product({0}, {0}) / 16 + 1e-5) * (1 + j % 3 * 0.1::DOUBLE))"


@query("decoder_block", f"""
    WITH s AS (SELECT vec_id // 16 AS block, vec_id, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS pos, embedding[1:16]::DOUBLE[] AS x FROM embeddings),
    n AS (SELECT *, {_NORM_SQL.format("x")} AS n FROM s),
    p AS (SELECT *, {_project_sql("n", 16, 16, 3, 5, 0)} AS q, {_project_sql("n", 8, 16, 5, 2, 1)} AS k, {_project_sql("n", 8, 16, 2, 3, 2)} AS v FROM n),
    r AS (SELECT block, vec_id, pos, {_rotated_sql("q", 16)} AS q, {_rotated_sql("k", 8)} AS k, v FROM p),
    e AS (SELECT a.vec_id, h, exp(list_dot_product(a.q[h * 4 + 1:h * 4 + 4], b.k[h // 2 * 4 + 1:h // 2 * 4 + 4]) / 2) AS w, b.v[h // 2 * 4 + 1:h // 2 * 4 + 4] AS v
        FROM r a JOIN r b ON a.block = b.block AND b.pos <= a.pos, (SELECT CAST(unnest(range(4)) AS INT) AS h)),
    c AS (SELECT vec_id, h, CAST(i AS INT) AS i, sum(w * v[i + 1]) / sum(w) AS v FROM e, (SELECT CAST(unnest(range(4)) AS INT) AS i) GROUP BY ALL),
    o AS (SELECT vec_id, list(v ORDER BY h, i) AS o FROM c GROUP BY vec_id),
    m AS (SELECT s.block, s.vec_id, list_transform(list_zip(x, {_project_sql("o", 16, 16, 4, 3, 3)}), lambda z: z[1] + z[2]) AS y FROM s JOIN o USING (vec_id)),
    f AS (SELECT *, {_NORM_SQL.format("y")} AS n FROM m),
    g AS (SELECT *, {_project_sql("n", 24, 16, 2, 5, 4)} AS gate, {_project_sql("n", 24, 16, 3, 2, 5)} AS up FROM f),
    u AS (SELECT *, list_transform(list_zip(gate, up), lambda z: z[1] / (1 + exp(-z[1])) * z[2]) AS u FROM g),
    d AS (SELECT block, vec_id, list_transform(list_zip(y, {_project_sql("u", 16, 24, 5, 3, 6)}), lambda z: z[1] + z[2]) AS z FROM u)
    SELECT block, vec_id, CAST(generate_subscripts(z, 1) - 1 AS BIGINT) AS i, round(unnest(z), 5) + 0.0 AS v FROM d""")
def decoder_block(spark, d):
    """Sequences of 16 vectors through a whole block: norm, four query and two key heads with rotary positions, causal
    attention, output projection, residual, norm, gated feed-forward, residual."""
    from bitloom.operators import decoder

    x = vectors(spark, d).select(F.floor(F.col("vec_id") / 16).alias("block"), "vec_id", F.slice("x", 1, 16).alias("x"))
    return _out(decoder.run(x, "block", "vec_id", [decoder_weights()]), F.col("out"), "block", "vec_id", digits=5)


def decoder_weights():
    """A small block whose weights are a rule."""
    import numpy as np

    from bitloom.operators import decoder

    def matrix(rows, cols, a, b, c):
        j, i = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
        return ((i * a + j * b + c) % 7 - 3) / 16

    norm = 1 + np.arange(16) % 3 * 0.1
    return decoder.Block(norm, matrix(16, 16, 3, 5, 0), matrix(8, 16, 5, 2, 1), matrix(8, 16, 2, 3, 2), matrix(16, 16, 4, 3, 3), norm, matrix(24, 16, 2, 5, 4), matrix(24, 16, 3, 2, 5), matrix(16, 24, 5, 3, 6), 4)


_QUERY_ROW = "q AS (SELECT i, avg(v) AS h FROM v GROUP BY i)"


@query("cosine_scores", f"WITH {_LONG}, {_QUERY_ROW} SELECT vec_id, round(sum(v * h), 6) + 0.0 AS dot, round(sum(v * h) / (sqrt(sum(v * v)) * sqrt(sum(h * h))), 6) + 0.0 AS cosine FROM v JOIN q ON q.i = v.i GROUP BY vec_id")
def cosine_scores(spark, d):
    """Every embedding row scored against the mean row."""
    x = vectors(spark, d).join(F.broadcast(_mean_row(spark, d)))
    return x.select("vec_id", (F.round(X.dot(F.col("x"), F.col("h")), 6) + 0.0).alias("dot"), (F.round(X.cosine(F.col("x"), F.col("h")), 6) + 0.0).alias("cosine"))


def _mean_row(spark, d):
    """One row: the mean of all embeddings (column h)."""
    means = long_vectors(spark, d).groupBy("i").agg(F.avg("v").alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("h"))


@query("mean_pool", f"WITH {_LONG} SELECT label, i, round(avg(v), 6) + 0.0 AS v FROM v GROUP BY ALL")
def mean_pool(spark, d):
    """Mean embedding of each label."""
    return long_vectors(spark, d).groupBy("label", "i").agg((F.round(F.avg("v"), 6) + 0.0).alias("v"))


@query("next_token_argmax", f"""WITH {_LONG}, h AS (SELECT label, i, avg(v) AS h FROM v GROUP BY ALL),
    s AS (SELECT h.label, v.vec_id, sum(v.v * h.h) / 0.8::DOUBLE AS s FROM v JOIN h ON h.i = v.i GROUP BY h.label, v.vec_id),
    r AS (SELECT label, vec_id, round(CASE WHEN vec_id % 10 = label THEN CASE WHEN s > 0 THEN s / 1.5::DOUBLE ELSE s * 1.5::DOUBLE END ELSE s END, 8) AS s FROM s)
    SELECT label, vec_id AS token, round(s, 6) + 0.0 AS score FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1""")
def next_token_argmax(spark, d):
    """Best-scoring row for each label's hidden vector, temperature 0.8 and penalty 1.5 for rows already used; lowest id on ties.

    The hidden vectors are one row a label, a bounded side; the best row is a partial aggregate.
    """
    return _argmax(spark, d, 64)


def _argmax(spark, d, limit):
    stride = 64 // limit
    hidden = long_vectors(spark, d).groupBy("label", "i").agg(F.avg("v").alias("m"))
    hidden = hidden.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("h"))
    hidden = hidden.agg(F.collect_list(F.struct("label", "h")).alias("hs"))
    rows = vectors(spark, d).select("vec_id", "x").join(F.broadcast(hidden)).select("vec_id", "x", F.explode("hs").alias("q"))
    thin = lambda c: F.filter(c, lambda _, i: i % stride == 0) if stride > 1 else c
    s = X.dot(thin(F.col("x")), thin(F.col("q.h"))) / 0.8
    scored = rows.select(F.col("q.label").alias("label"), "vec_id", s.alias("s"))
    used = F.when(F.col("s") > 0, F.col("s") / 1.5).otherwise(F.col("s") * 1.5)
    scored = scored.select("label", "vec_id", F.round(F.when(F.col("vec_id") % 10 == F.col("label"), used).otherwise(F.col("s")), 8).alias("s"))
    best = scored.groupBy("label").agg(F.max(F.struct("s", (-F.col("vec_id")).alias("n"))).alias("b"))
    return best.select("label", (-F.col("b.n")).alias("token"), (F.round("b.s", 6) + 0.0).alias("score"))


@query("strided_logits", f"""WITH {_LONG}, h AS (SELECT label, i, avg(v) AS h FROM v GROUP BY ALL),
    s AS (SELECT h.label, v.vec_id, sum(v.v * h.h) / 0.8::DOUBLE AS s FROM v JOIN h ON h.i = v.i WHERE v.i % 4 = 0 GROUP BY h.label, v.vec_id),
    r AS (SELECT label, vec_id, round(CASE WHEN vec_id % 10 = label THEN CASE WHEN s > 0 THEN s / 1.5::DOUBLE ELSE s * 1.5::DOUBLE END ELSE s END, 8) AS s FROM s)
    SELECT label, vec_id AS token, round(s, 6) + 0.0 AS score FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1""")
def strided_logits(spark, d):
    """The same from every fourth dimension."""
    return _argmax(spark, d, 16)


@query("sanitise_hidden", f"""WITH {_LONG}, w AS (SELECT vec_id, i, CASE WHEN i = vec_id % 64 THEN 0.0 ELSE v * 4000 END AS v FROM v), m AS (SELECT vec_id, max(abs(v)) AS a FROM w GROUP BY vec_id)
    SELECT vec_id, i, round(CASE WHEN a > 1000 THEN v * 1000 / a ELSE v END, 5) + 0.0 AS v FROM w JOIN m USING (vec_id)""")
def sanitise_hidden(spark, d):
    """Vectors with a NaN put in, made finite and scaled into range."""
    odd = vectors(spark, d).withColumn("x", F.transform("x", lambda v, i: F.when(i == F.col("vec_id") % 64, float("nan")).otherwise(v * 4000)))
    return _out(odd, X.sanitise(F.col("x")), "vec_id", digits=5)


@query("finite_dot", f"WITH {_LONG} SELECT vec_id, round(sum(v * (i + 1)) FILTER (i <> vec_id % 64), 6) AS y FROM v GROUP BY vec_id")
def finite_dot(spark, d):
    """Dot product that skips pairs with a NaN."""
    odd = F.transform("x", lambda v, i: F.when(i == F.col("vec_id") % 64, float("nan")).otherwise(v))
    return vectors(spark, d).select("vec_id", F.round(X.finite_dot(odd, F.transform("x", lambda _, i: (i + 1).cast("double"))), 6).alias("y"))


@query("tensor_valid", f"WITH {_LONG} SELECT vec_id, count(*) = 64 AS right_size, bool_and(isfinite(v)) AS finite, 64 % 8 = 0 AS square FROM v GROUP BY vec_id")
def tensor_valid(spark, d):
    """Size and finiteness checks."""
    x = vectors(spark, d)
    finite = F.forall("x", lambda v: ~F.isnan(v) & ~v.isin(float("inf"), float("-inf")))
    return x.select("vec_id", (F.size("x") == 64).alias("right_size"), finite.alias("finite"), (F.size("x") % 8 == 0).alias("square"))


@query("broadcastable", """
    SELECT a, b, (a[1] = b[1] OR a[1] = 1 OR b[1] = 1) AND (a[2] = b[2] OR a[2] = 1 OR b[2] = 1) AS ok, a[2] = b[1] AS can_multiply
    FROM (SELECT DISTINCT [p_size % 3 + 1, p_size % 4 + 1] AS a FROM part), (SELECT DISTINCT [p_size % 4 + 1, p_size % 3 + 1] AS b FROM part)""")
def broadcastable(spark, d):
    """Which shapes can be added or multiplied (shape lists of a dozen entries)."""
    p = table(spark, d, "part").select((F.col("p_size") % 3 + 1).alias("m"), (F.col("p_size") % 4 + 1).alias("n")).distinct()
    shapes = p.agg(F.collect_set(F.array("m", "n")).alias("a"), F.collect_set(F.array("n", "m")).alias("b"))
    each = shapes.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    fit = lambda i: (F.get("a", F.lit(i)) == F.get("b", F.lit(i))) | (F.get("a", F.lit(i)) == 1) | (F.get("b", F.lit(i)) == 1)
    return each.select("a", "b", (fit(0) & fit(1)).alias("ok"), (F.get("a", F.lit(1)) == F.get("b", F.lit(0))).alias("can_multiply"))


@query("layer_graph", f"""WITH {_LONG}, a AS (SELECT vec_id, i, v, v / sqrt(avg(v * v) OVER (PARTITION BY vec_id) + 1e-5) AS n FROM v)
    SELECT vec_id, i, round(v + greatest(n, 0.0) + tanh(n), 5) + 0.0 AS v FROM a""")
def layer_graph(spark, d):
    """A small graph of layers: a norm read by two activations, whose sum is added to the input."""
    from bitloom.operators.layers import Graph, elementwise

    plus = lambda *xs: xs[0] if len(xs) == 1 else F.zip_with(xs[0], plus(*xs[1:]), lambda a, b: a + b)
    g = Graph().add("in", lambda x: x).add("norm", X.rms_norm, ["in"]).add("relu", elementwise("relu"), ["norm"]).add("tanh", elementwise("tanh"), ["norm"]).add("sum", plus, ["in", "relu", "tanh"])
    return _out(g.run(vectors(spark, d), "x", "sum"), F.col("sum"), "vec_id", digits=5)


@query("boundary_fit")
def boundary_fit(spark, d):
    """Boundaries of the value buckets after the optimiser's rounds (iterative; tested against a plain loop)."""
    from bitloom.operators.layers import fit_boundaries

    edges = fit_boundaries(table(spark, d, "events"), "value")
    return spark.createDataFrame(list(enumerate(edges)), "boundary int, at double")


@query("dictionary_fit_groups")
def dictionary_fit_groups(spark, d):
    """One dictionary for each label, and what its codes leave of all the label's vectors (iterative; tested on its error)."""
    from bitloom.operators import dictionary as D

    x = vectors(spark, d).select(F.col("vec_id").alias("tile"), "label", "x")
    atoms = D.fit_groups(x, "label", 16, D.gammas(2), 3, 4)
    return D.group_errors(x, "label", atoms, D.gammas(2), 3)
