"""Every record type as an explicit Spark schema; nothing is inferred."""

SEGMENTS = "array<struct<id:string,text:string,is_required:int>>"
NODES = "array<struct<id:string,text:string>>"
EDGES = "array<array<string>>"

EXAMPLE = "example_id string, question string, answer string, final_answer string"

RESULT = (
    f"{EXAMPLE}, cot string, segments {SEGMENTS}, required_segments {SEGMENTS}, "
    f"nodes {NODES}, edges {EDGES}, success boolean, pipeline_type string, error string"
)

COMPLEXITY = (
    "struct<complexity:string,estimated_paths:string,nodes:int,edges:int,"
    "constraint_ratio:double,source_nodes:int,sink_nodes:int,source_sink_pairs:int,"
    "use_sampling:boolean>"
)

PATHS = (
    f"example_id string, complexity_estimate {COMPLEXITY}, method string, total_paths int, "
    "paths array<struct<sequence:array<string>,texts:array<string>>>, error string"
)

SFT = "split string, id string, question string, answer string, final_answer string"

MULTIHOP_RAW = (
    "_id string, question string, answer string, type string, level string, "
    "supporting_facts array<array<string>>, context array<array<string>>"
)

TOOL_ROW = "id bigint, query string, tools string, answers string"

RESPONSE = "example_id string, stage string, response string"
