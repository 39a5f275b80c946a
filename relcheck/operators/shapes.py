"""Reshaping of records: nested samples, pairs, jobs, scene graphs (PR, SO)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from relcheck.functions.answers import pred_yes
from relcheck.functions.text import canonical_id, capitalised


def first_filled(*cols: Column) -> Column:
    """PR-02: the first that is neither null nor ''; '' if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def canonical_questions(df: DataFrame, suffix: str = "") -> DataFrame:
    """PR-01: question_id, image, text by fallbacks on columns that exist; a question without text fails."""
    has = lambda *names: [F.col(n) for n in names if n in df.columns] or [F.lit(None)]
    text = F.coalesce(*has("text", "question", "prompt"), F.raise_error(F.lit("a question has no text")).cast("string"))
    return df.select(F.coalesce(*[c.cast("string") for c in has("question_id", "id", "ord")]).alias("question_id"), F.coalesce(*has("image", "image_path", "file_name")).alias("image"), F.concat(text, F.lit(suffix)).alias("text"))


def canonical_records(df: DataFrame, raw: str, order: Column, suffix: str = "") -> DataFrame:
    """PR-01 for records that still are JSON text: the first key that is present decides, even where its value is null, which a
    table's columns can't tell. question_id (else id, else order), image, text (with suffix, if told, behind its stripped end)
    and label (null if there is none), all as text. A record without image or text, or that is no object, fails the job."""
    keys, value = F.json_object_keys(raw), lambda name: F.get_json_object(raw, f"$.{name}")

    def by_presence(names: tuple[str, ...], otherwise: Column) -> Column:
        out = otherwise
        for name in reversed(names):
            out = F.when(F.array_contains(keys, name), value(name)).otherwise(out)
        return out

    nothing = F.lit(None).cast("string")
    needed = lambda x: F.coalesce(x, F.raise_error(F.concat(F.lit("a question has no text or image: "), F.coalesce(raw, F.lit("null")))).cast("string"))
    text = needed(by_presence(("text", "question", "prompt"), nothing))
    return df.select(
        by_presence(("question_id", "id"), order.cast("string")).alias("question_id"),
        needed(by_presence(("image", "image_path", "file_name"), nothing)).alias("image"),
        (F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit(suffix)) if suffix else text).alias("text"),
        value("label").alias("label"),
    )


def conversations(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """PR-05: a row per conversation with its turns as array<struct<from, value>> in order."""
    each = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("from"), F.col(text).alias("value"))))
    return turns.groupBy(key).agg(F.transform(each, lambda t: t.dropFields("turn")).alias("conversations"))


def last_turn(turns: DataFrame, key: str, turn: str, role: str, text: str, roles: tuple[str, ...] = ("gpt", "assistant")) -> DataFrame:
    """PR-03: the last turn of one of the roles."""
    return turns.where(F.col(role).isin(*roles)).groupBy(key).agg(F.max_by(text, turn).alias("text"))


def first_turn(turns: DataFrame, key: str, turn: str, role: str, text: str, roles: tuple[str, ...] = ("human", "user")) -> DataFrame:
    """PR-04: the first turn of one of the roles, without the image's marker."""
    bare = F.regexp_replace(F.min_by(text, turn), r"(?i)<image>\s*", "")
    return turns.where(F.col(role).isin(*roles)).groupBy(key).agg(bare.alias("text"))


def training_sample(sample_id: Column, statement: Column, label: Column) -> Column:
    """PR-05, PR-09: the nested record of a yes/no question; any label but yes is no."""
    answer = F.when(F.lower(label) == "yes", "yes").otherwise("no")
    turns = F.array(F.struct(F.lit("human").alias("from"), statement.alias("value")), F.struct(F.lit("gpt").alias("from"), capitalised(answer).alias("value")))
    return F.struct(sample_id.alias("id"), turns.alias("conversations"), answer.alias("label"))


def expanded(df: DataFrame, keep: list[str], **variants: Column) -> DataFrame:
    """PR-06, PR-07, UD-04: a row for each variant (name: statement) that isn't null or empty, in the order told."""
    each = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("variant"), v.alias("statement")) for i, (k, v) in enumerate(variants.items())])
    filled = F.filter(each, lambda x: x.statement.isNotNull() & (x.statement != ""))
    return df.select(*keep, F.explode(filled).alias("v")).select(*keep, "v.*")


def tagged_union(**parts: DataFrame) -> DataFrame:
    """PR-08, SO-01: union all of tables with different columns, tagged by name."""
    out = None
    for tag, df in parts.items():
        df = df.withColumn("tag", F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def candidates(df: DataFrame, keep: list[str], attempts: str) -> DataFrame:
    """PR-10: attempts: array<struct<attempt, candidates: array<struct<..>>>> as rows; nulls are empty arrays."""
    each = df.select(*keep, F.explode(attempts).alias("a"))
    return each.select(*keep, "a.attempt", F.posexplode("a.candidates").alias("rank", "c")).select(*keep, "attempt", "rank", "c.*")


def graph_triplets(df: DataFrame, keep: list[str], names: Column, edges: Column) -> DataFrame:
    """PR-11: edges [s, o, p] between node numbers as subject, object, predicate; edges out of range go. The names are looked
    up before the edges become rows, so that no row carries all names."""
    return df.select(*keep, F.explode(triplet_list(names, edges)).alias("e")).select(*keep, "e.edge", "e.subject", "e.object", "e.predicate")


def triplet_list(names: Column, edges: Column) -> Column:
    """PR-11: a graph's triplets as an array of structs of edge, subject, object and predicate."""

    def told(own: Column) -> Column:
        inside = lambda i: (i >= 0) & (i < F.size(own))
        row = lambda e, i: F.struct(i.alias("edge"), F.get(own, e[0]).alias("subject"), F.get(own, e[1]).alias("object"), e[2].alias("predicate"), (inside(e[0]) & inside(e[1])).alias("_in"))
        return F.filter(F.transform(edges, row), lambda x: x["_in"])

    return F.transform(F.array(names), told)[0]  # names are made once a row


def public(df: DataFrame, *dropped: str) -> DataFrame:
    """PR-12: without the columns told and those that begin with an underscore, at any depth of structs and arrays."""
    gone = lambda name: name in dropped or name.startswith("_")

    def bare(x: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            return F.when(x.isNotNull(), F.struct(*[bare(x.getField(f.name), f.dataType).alias(f.name) for f in kind if not gone(f.name)]))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | ArrayType):
            return F.transform(x, lambda y: bare(y, kind.elementType))
        return x

    return df.select(*[bare(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if not gone(f.name)])


def retagged(df: DataFrame, fields: dict[str, dict[str, Column]] | None = None, **columns: Column) -> DataFrame:
    """PR-13: the rows with some columns, and fields of struct columns ({struct: {field: value}}), replaced or added."""
    for name, own in (fields or {}).items():
        x = F.col(name)
        for field, value in own.items():
            x = x.withField(field, value)
        columns[name] = x
    return df.withColumns(columns)


def first_present(*structs: Column) -> Column:
    """PR-16: the first struct that isn't null and has a field that isn't."""
    return F.coalesce(*[F.when(F.to_json(s) != "{}", s) for s in structs])


def answer_predictions(log: DataFrame, order: str) -> DataFrame:
    """PR-15: qid, pred of an answer log with question_id or id, text or response, by fallbacks on columns that exist; the last
    answer of a question counts, an empty answer is yes."""
    has = lambda *names: [F.col(n) for n in names if n in log.columns] or [F.lit(None).cast("string")]
    qid = canonical_id(F.coalesce(*[c.cast("string") for c in has("question_id", "id")]))
    told = log.select(qid.alias("qid"), pred_yes(first_filled(*has("text", "response"))).alias("pred"), F.col(order).alias("_order"))
    return told.groupBy("qid").agg(F.max_by("pred", "_order").alias("pred"))


def vocabulary_of(df: DataFrame, *cols: str) -> DataFrame:
    """SO-05: the different non-empty values of several columns."""
    return df.select(F.explode(F.array(*cols)).alias("term")).where(F.col("term") != "").distinct()


def subset_of(df: DataFrame, equal: dict[str, object], extra: Column | None = None) -> DataFrame:
    """FL-27: rows with these values (None: null) in these columns, and for which extra, if told, is true. Without values and
    extra all rows stay."""
    for name, value in equal.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df if extra is None else df.where(extra)
