"""Fixed defaults shared by every job."""

CHUNK_SIZE = 1200
CHUNK_OVERLAP = 100

CHAR_CHUNK_SIZE = 1200
CHAR_CHUNK_OVERLAP = 100

TUPLE_DELIMITER = "<|>"
RECORD_DELIMITER = "##"
COMPLETION_DELIMITER = "<|COMPLETE|>"

MAX_CLUSTER_SIZE = 10
COMMUNITY_LEVEL = 2

EMBED_BATCH_TEXTS = 16
EMBED_BATCH_TOKENS = 8191

REPORT_CONTEXT_TOKENS = 16_000
SEARCH_BATCH_TOKENS = 12_000
REDUCE_TOKENS = 12_000
SUMMARY_INPUT_TOKENS = 4_000
CONVERSATION_TOKENS = 8_000
CONVERSATION_TURNS = 5

SHUFFLE_SEED = 86

# A group with more rows than this is never handed to one task as a whole.
HOT_GROUP_ROWS = 2_000_000
# Rows that one task gets when a hot group is cut into ordered blocks.
BLOCK_ROWS = 500_000
# Longest array put into one cell; longer groups go on in further rows.
PAGE_ROWS = 50_000
# Rows of the small side a broadcast or a cross product may hold.
BROADCAST_ROWS = 100_000
# Bytes of text that side may hold, as it passes through the driver whole.
BROADCAST_BYTES = 32 << 20
# Rows of each side that one task of a larger cross product pairs.
GRID_ROWS = 5_000
# Bytes of text of each side that such a task pairs.
GRID_BYTES = 64 << 20
