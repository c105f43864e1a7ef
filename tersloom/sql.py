"""SQL functions: token_count, strip_stopwords, first_sentence, transpile and the table function parse_document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tersloom import kernel as K
from tersloom import model as M

_NODE_ROW = T.StructType([f for f in M.NODE.fields])


class ParseDocument:
    """A row for each node of one document."""

    def eval(self, text: str, kind: str):
        for i, n in enumerate(K.parse(K.strip_pua(text or ""), kind)):
            r = n.row(i)
            yield tuple(r[f.name] for f in M.NODE.fields)


def register(spark: SparkSession) -> None:
    """Arrow-batched functions for SQL text; DataFrame code uses the column functions, which stay in the JVM."""
    each = lambda fn: lambda s: s.map(lambda x: None if x is None else fn(x))

    def counted(s: pd.Series) -> pd.Series:
        return each(K.token_count)(s)

    def stripped(s: pd.Series) -> pd.Series:
        return each(K.Stopwords().strip)(s)

    def sentence(s: pd.Series) -> pd.Series:
        return each(K.first_sentence)(s)

    def transpiled(text: pd.Series, kind: pd.Series, fidelity: pd.Series, budget: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else K.transpile(t, k, f, None if b is None or pd.isna(b) else int(b)) for t, k, f, b in zip(text, kind, fidelity, budget, strict=True)])

    spark.udf.register("token_count", F.pandas_udf(counted, "int"))
    spark.udf.register("strip_stopwords", F.pandas_udf(stripped, "string"))
    spark.udf.register("first_sentence", F.pandas_udf(sentence, "string"))
    spark.udf.register("transpile", F.pandas_udf(transpiled, "string"))
    spark.udtf.register("parse_document", F.udtf(ParseDocument, returnType=_NODE_ROW))
