"""Schemas of the main tables, as DDL."""

NODES = "id string, name string, type string, properties string, created_at timestamp_ntz, updated_at timestamp_ntz"
EDGES = "source_id string, target_id string, relationship_name string, properties string, created_at timestamp_ntz, updated_at timestamp_ntz"
VECTORS = "collection string, id string, vector array<float>, metadata map<string,string>, dataset_ids array<string>"
CHUNKS = "doc_id string, chunk_index int, text string, chunk_size int, cut_type string, chunk_id string"
DATA = "id string, name string, raw_data_location string, extension string, mime_type string, content_hash string, owner_id string, external_metadata string, token_count bigint, data_size bigint"
SESSIONS = "session_id string, user_id string, dataset_id string, status string, started_at timestamp_ntz, last_activity_at timestamp_ntz, ended_at timestamp_ntz, tokens_in bigint, tokens_out bigint, cost_usd double"
CENTROIDS = "dataset_id string, slot int, count int, truth_epoch bigint, centroid array<double>, learning_ids array<string>"
TRIPLES = "s string, p string, o string"
