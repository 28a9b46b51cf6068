"""Row types of the relations the engine moves."""

FILES = "file_id bigint, codebase string, path string, relative_path string, size bigint, extension string, language string, encoding string, hash string, content string"
CHUNKS = "relative_path string, chunk_no int, start_line int, end_line int, chunk_type string, language string, tokens bigint, content string"
ELEMENTS = "name string, element_type string, start_line int, end_line int, visibility string, language string, pattern string, metadata string"
DEPENDENCIES = "name string, import_type string, source string, alias string, line_number int"
REQUESTS = "relative_path string, chunk_no int, language string, chunk_type string, content string"
RESPONSES = "relative_path string, chunk_no int, summary string, tokens_used bigint, processing_time double, model_used string, provider_used string, error string, fallback_used boolean"
ATTEMPTS = "relative_path string, chunk_no int, provider string, attempt int, ok boolean, tokens bigint"
ELEMENT_TYPES = ("function", "method", "class", "struct", "interface", "trait", "enum", "constant", "variable", "import", "module", "namespace")
VISIBILITIES = ("public", "private", "protected", "internal")
