"""From texts to ranked entries: normalise, chunk, embed, search, judge. Whole tables of texts at a time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import textnorm, vectors
from treeline.operators import chunking, embed, rerank, scheme, search
from treeline.operators import index as index_builds
from treeline.operators.search import Params
from treeline.session import cut

CHUNKINGS = ("mean", "max", "truncate")
#: What a request may set; other names are left out silently.
REQUEST = {"level", "top_k", "gap", "auto_margin", "normalize", "chunking", "rerank", "candidates", "fusion"}


@dataclass(frozen=True)
class Options:
    """Of a classification."""

    params: Params = field(default_factory=Params)
    normalize: bool = True
    chunking: str = "mean"
    rerank: str | None = None
    candidates: int | None = None
    fusion: str = "blend"

    def __post_init__(self) -> None:
        if self.chunking not in CHUNKINGS:
            raise ValueError(f"chunking must be one of {CHUNKINGS}, not {self.chunking}")


@dataclass(frozen=True)
class Index:
    """An embedded edition: entries (vec_id, ed, symbol, path, vector), details (ed, symbol, title, text, depth) and the model."""

    entries: DataFrame
    details: DataFrame
    model: str


def build_index(nodes: DataFrame, spec: str = "hash:64", old: DataFrame | None = None, old_spec: str | None = None) -> Index:
    """Renders and embeds every entry of ``nodes`` that has a path; all its editions are kept apart.

    ``old`` (version of the edition to build, lang, symbol, text_hash, vector) gives earlier vectors, as ``index.build`` takes them.
    """
    n, r = scheme.entries(nodes), cut(scheme.rendered(nodes))
    texts, paths = r.drop("path"), r.select(*scheme.EDITION, "symbol", "path")
    ed = F.concat_ws(":", "version", "lang").alias("ed")
    v = index_builds.build(texts, old, spec, old_spec).drop("text_hash")
    e = n.join(paths, [*scheme.EDITION, "symbol"]).join(v, [*scheme.EDITION, "symbol"])
    details = n.join(texts, [*scheme.EDITION, "symbol"]).select(ed, "symbol", "title", "text", F.col("depth").cast("int").alias("depth"))
    # Searches read an index several times, so that it is written once.
    return Index(cut(e.select(F.col("node_id").alias("vec_id"), ed, "symbol", "path", "vector")), cut(details), spec)


def embed_texts(texts: DataFrame, spec: str, chunks: str = "mean") -> DataFrame:
    """(query_id, chunk, n_chunks, vector) of texts (query_id, text).

    A text of one chunk is embedded as it stands; ``mean`` gives the unit mean of the chunks' vectors, ``max`` a vector for each
    chunk, ``truncate`` embeds the text whole and leaves the cut to the model. NULL and blank texts have no rows.
    """
    e = embed.get_embedder(spec)
    t = texts.where(F.col("text").isNotNull() & (textnorm.squeeze(F.col("text")) != "")).select(F.col("query_id").cast("long").alias("query_id"), "text")
    if chunks == "truncate":
        c = t.select("query_id", F.lit(0).alias("chunk"), F.lit(1).alias("n_chunks"), "text")
    else:
        if e.max_tokens is None:
            c = chunking.paragraph_chunks(t, "query_id", "text")
        else:
            c = chunking.chunk(t, "query_id", "text", e.max_tokens, lambda s: embed.get_embedder(spec).count_tokens(s))
        whole = t.withColumnRenamed("text", "whole")
        c = c.join(whole, "query_id").select("query_id", "chunk", "n_chunks", F.when(F.col("n_chunks") == 1, F.col("whole")).otherwise(F.col("text")).alias("text"))
    keys = ["query_id", "chunk", "n_chunks"]
    v = embed.hash_embed(c, keys, "text", e.dim) if spec.startswith("hash") else embed.model_embed(c, keys, "text", spec)
    if chunks != "mean":
        return v
    mean = vectors.mean_vectors(v, ["query_id"], "vector").withColumnRenamed("mean", "vector")
    return v.groupBy("query_id").agg(F.max("n_chunks").alias("n_chunks")).join(mean, "query_id").select("query_id", F.lit(0).alias("chunk"), "n_chunks", "vector")


def classify(texts: DataFrame, index: Index, model: str, o: Options = Options()) -> DataFrame:
    """(query_id, ed, rank, symbol, pretty, level, depth, title, text, similarity, score, judge) of texts (query_id, text).

    The model must be the index's. With ``rerank`` the first stage gives more candidates, and the judge reads the normalised
    text; ``score`` is then the fused one. Texts without words, and NULL ones, have no results.
    """
    if model != index.model:
        raise ValueError(f"the index was built with {index.model}, not {model}")
    t = texts.select("query_id", textnorm.normalize_query(F.col("text")).alias("text")) if o.normalize else texts.select("query_id", "text")
    q = embed_texts(t, model, o.chunking)
    p = o.params
    wide = rerank.candidates(p.top_k, o.candidates, o.rerank is not None)
    first = Params(p.level, wide, p.gap, p.dedupe, p.margin, p.roots, p.weights, p.beam)
    if o.chunking == "max":
        # Chunks have numbers of their own, which are joined back to their texts.
        q = cut(q.withColumn("one", F.monotonically_increasing_id()))
        owner = q.select("one", F.col("query_id").alias("text_id"))
        whole = lambda s: search.max_over_chunks(s.withColumnRenamed("query_id", "one").join(owner, "one").select(F.col("text_id").alias("query_id"), "vec_id", "similarity"))
        found = search.search(q.select(F.col("one").alias("query_id"), "vector"), index.entries, first, reduce=whole)
    else:
        found = search.search(q.select("query_id", "vector"), index.entries, first)
    if o.rerank:
        # Of the many candidates only texts are fetched, and they go once they are judged; the rest is for the few that stay.
        pairs = found.drop("path").join(index.details.select("ed", "symbol", "text"), ["ed", "symbol"]).join(t.withColumnRenamed("text", "query"), "query_id")
        judged = rerank.model_logits(pairs, o.rerank).drop("text", "query")
        found = rerank.fused(judged, ["query_id", "ed"], o.fusion, p.top_k)
    else:
        found = found.withColumn("judge", F.lit(None).cast("double"))
    from treeline.functions import symbols

    found = found.drop("path").join(index.details, ["ed", "symbol"])
    return found.select("query_id", "ed", "rank", "symbol", symbols.pretty(F.col("symbol")).alias("pretty"), "level", "depth", "title", "text", "similarity", "score", "judge")


def request_options(parameters: dict | None) -> Options:
    """Options of a request; names that are not for requests are left out."""
    r = {k: v for k, v in (parameters or {}).items() if k in REQUEST}
    p = {new: r[old] for old, new in (("level", "level"), ("top_k", "top_k"), ("gap", "gap"), ("auto_margin", "margin")) if old in r}
    return Options(Params(**p), **{k: r[k] for k in ("normalize", "chunking", "rerank", "candidates", "fusion") if k in r})


def respond(found: DataFrame) -> DataFrame:
    """Results as a service gives them: printed and canonical symbol, scores rounded half to even to four places."""
    return found.select(
        "query_id", "ed", "rank", F.col("pretty").alias("symbol"), F.col("symbol").alias("canonical"), "level", "depth", F.bround("score", 4).alias("score"), F.bround("similarity", 4).alias("similarity"),
        F.bround("judge", 4).alias("judge"), "title", F.col("text").alias("path"),
    )


def respond_json(found: DataFrame) -> DataFrame:
    """(query_id, response): a JSON list for each query; lists are at most top_k long for each edition."""
    r = respond(found)
    body = F.struct("ed", "rank", *[c for c in r.columns if c not in ("query_id", "ed", "rank")])
    return r.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(body))).alias("response"))


def graph(found: DataFrame) -> DataFrame:
    """(query_id, ed, parent, symbol, rank): the edges of all result paths merged, with the best rank through each node; parent NULL at a root."""
    # Paths are shuffled, which are fewer and shorter than their edges.
    found = found.select("query_id", "ed", "rank", "path").repartition("query_id", "ed")
    each = found.select("query_id", "ed", "rank", F.split("path", r"\|").alias("p")).select("query_id", "ed", "rank", F.posexplode("p").alias("i", "symbol"), "p")
    return each.select("query_id", "ed", F.when(F.col("i") > 0, F.try_element_at("p", F.col("i"))).alias("parent"), "symbol", "rank").groupBy("query_id", "ed", "parent", "symbol").agg(F.min("rank").alias("rank"))


#: The most indexes that are kept; the one that was not used for longest is released first.
MOST_CACHED = 8
_CACHE: dict[tuple, Index] = {}


def cached_index(spark: SparkSession, path: str, version: str, lang: str, spec: str) -> Index:
    """The index of one edition of a nodes table, kept for later calls of the same application."""
    key = (spark.sparkContext.applicationId, path, version, lang.upper(), spec)
    found = _CACHE.pop(key, None)
    if found is None:
        nodes = spark.read.parquet(path).where((F.col("version") == version) & (F.upper("lang") == lang.upper()))
        i = build_index(nodes, spec)
        found = Index(i.entries.persist(), i.details.persist(), i.model)
    _CACHE[key] = found
    for other in [k for k in _CACHE if k[0] != key[0]]:
        del _CACHE[other]
    while len(_CACHE) > MOST_CACHED:
        dropped = _CACHE.pop(next(iter(_CACHE)))
        dropped.entries.unpersist()
        dropped.details.unpersist()
    return found


def judge_candidates(texts: DataFrame, index: Index, model: str, reranker: str, candidates: int = 25, level: str = "subgroup") -> DataFrame:
    """(query_id, ed, rank, symbol, text, score, logit): first-stage candidates of texts (query_id, text) with a reranker's logits.

    The run that ``evaluate.fusion_results`` compares the fusions from, so that every pair is judged once.
    """
    found = classify(texts, index, model, Options(Params(level=level, top_k=candidates)))
    pairs = found.join(texts.select("query_id", textnorm.normalize_query(F.col("text")).alias("query")), "query_id")
    return rerank.model_logits(pairs, reranker).select("query_id", "ed", "rank", "symbol", "text", "score", "logit")
