"""Fixed schemas of the long-form data model.

A response matrix is stored as one row per *asked* cell.  A cell that was not
asked has no row; NaN never reaches these tables (see ``operators.clean``).
"""

from pyspark.sql import types as T


def _table(*columns):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in columns])


_long, _text, _real = T.LongType(), T.StringType(), T.DoubleType()

RESPONSES = _table(("taker", _long, False), ("item", _long, False), ("y", T.ByteType(), True))
ITEMS = _table(("item", _long, False), ("input_text", _text, True),
               ("scenario", _text, True), ("benchmark", _text, True))
TAKERS = _table(("taker", _long, False), ("name", _text, True))
ITEM_PARAMETERS = _table(("item", _long, False), ("a", _real, True), ("d", _real, True))
LOADINGS = _table(("item", _long, False), ("factor", T.IntegerType(), False),
                  ("loading", _real, True))
SCENARIO_SCORES = _table(("taker", _long, False), ("scenario", _text, False), ("p", _real, True))
EMBEDDINGS = _table(("vec_id", _long, True), ("embedding", T.ArrayType(T.FloatType()), True),
                    ("label", T.IntegerType(), True))
FIT_INDICES = _table(("n_dimensions", T.IntegerType(), False), ("train_auc", _real, True),
                     ("test_auc", _real, True), ("train_cttcorr", _real, True),
                     ("test_cttcorr", _real, True), ("log_likelihood", _real, True),
                     ("AIC", _real, True), ("BIC", _real, True))
