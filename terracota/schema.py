"""Column sets of advert pages, raw listings and request logs."""

from pyspark.sql import types as T

_TEXT = ("titulo", "metragem", "banheiros", "vagas", "quartos", "valor_venda", "condominio", "endereco", "iptu", "descricao", "data_criacao")

#: One advert as the page words it; every scalar is text.
RAW = T.StructType([T.StructField("url", T.StringType(), False), *(T.StructField(c, T.StringType()) for c in _TEXT), T.StructField("caracteristicas", T.ArrayType(T.StringType())), T.StructField("fotos", T.ArrayType(T.StringType())), T.StructField("link_maps", T.StringType())])
RAW_COLUMNS = RAW.fieldNames()

#: The older typed record, and where its columns are in the current one.
OLD_NAMES = {"data_publicacao": "data_criacao", "valor_condominio": "condominio", "url_imagem": "fotos"}

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
REQUESTS = T.StructType([T.StructField("unique_key", T.StringType()), T.StructField("url", T.StringType()), T.StructField("method", T.StringType()), T.StructField("retry_count", T.IntegerType()), T.StructField("status", T.IntegerType()), T.StructField("duration_ms", T.DoubleType()), T.StructField("finished", T.BooleanType()), T.StructField("handled_at", T.TimestampType())])
