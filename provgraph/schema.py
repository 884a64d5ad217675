"""Schemas of the graph's tables."""

SPAN = "struct<doc_id: string, start: bigint, end: bigint, hash: string>"
DOCS = "doc_id string, path string, format string, raw binary, text string, raw_len bigint"
BLOCKS = "doc_id string, ord int, parent int, kind string, level int, start int, end int, text string, props map<string,string>"
CHUNKS = "doc_id string, index int, breadcrumb array<string>, start int, end int, text string, token_count int, layout_type string"
MENTIONS = "doc_id string, etype string, surface string, norm string, start int, end int"
RELATIONS = "doc_id string, subject_id string, predicate string, object_id string, surface string, start int, end int, polarity string, modality string, inferred boolean, amount string"
SENTENCES = "doc_id string, block int, start int, end int, sentence string"
NODES = "node_id string, labels array<string>, name string, props map<string,string>"
EDGES = f"edge_id string, subject string, predicate string, object string, tag string, confidence double, evidence_count bigint, source_spans array<{SPAN}>, props map<string,string>"
CLAIMS = "claim_id string, subject string, predicate string, object string, polarity string, modality string, t_valid string, t_invalid string, confidence double, doc_id string"

TAGS = ("STRUCTURAL", "EXTRACTED", "INFERRED", "GENERATED")
