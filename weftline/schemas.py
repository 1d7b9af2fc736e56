"""Schemas of the tables that ingestion writes."""

SECTION = "struct<anchor:string,label:string,level:int,kind:string,symbol:string,params:array<string>,source_url:string>"
MARKERS = f"struct<module:string,symbols:array<string>,sections:array<{SECTION}>,keywords:array<string>>"
PAGES = f"url string, title string, section string, markdown string, char_count int, saved_path string, markers {MARKERS}"
INDEX = f"url string, title string, section string, char_count int, saved_path string, markers {MARKERS}"
CHUNKS = (
    "chunk_id string, text string, page_url string, citation_url string, anchor string, page_title string, section string, kind string, "
    "symbol string, keywords array<string>, params array<string>, source_url string, char_count int, is_continuation boolean, sub_index int"
)
VECTORS = "chunk_id string, embedding array<float>"
SCORES = "qid string, metric string, score double"
MARKDOWN = "url string, saved_path string, markdown string"
