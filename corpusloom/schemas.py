"""Table layouts shared by the operators, as DDL strings."""

MANIFEST = "item STRING, kind STRING"
RESULTS = (
    "item STRING, files ARRAY<STRING>, metadata MAP<STRING,STRING>, "
    "success BOOLEAN, error STRING"
)
FILE_STATUS = "item STRING, file STRING, n_chunks BIGINT, insert_ok BOOLEAN"
FILES = "repo STRING, path STRING, content BINARY"
CODE_FILES = "file_id BIGINT, path STRING, text STRING"
CHUNKS = "chunk_id STRING, source STRING, seq BIGINT, text STRING, n_tokens BIGINT"
NODES = "id STRING, entity_type STRING, description STRING, source_id STRING"
EDGES = (
    "source STRING, target STRING, weight DOUBLE, description STRING, "
    "keywords STRING, source_id STRING"
)
SITEMAPS = "sitemap_url STRING, xml STRING"
CONTEXTS = "query_id BIGINT, context STRING"
QUERIES = "query_id BIGINT, text STRING, mode STRING, top_k INT"
RELATION_ROWS = (
    "id STRING, source STRING, target STRING, description STRING, "
    "keywords STRING, weight DOUBLE, source_id STRING"
)
