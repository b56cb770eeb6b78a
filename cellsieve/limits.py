"""Size bounds checked before anything is broadcast or held in a task."""

# A block of queries (vectors, probe lists, running top-k) that one Python task may hold.
QUERY_BLOCK_BYTES = 128 * 1024 * 1024

# A matrix of centroids shipped to every task.
MATRIX_BYTES = 128 * 1024 * 1024

# From so many centroids on, nearest cells are found by groups of centroids.
TREE_CELLS = 4096

# Similarity tiles computed at once inside a task (entries of a double matrix).
TILE_ENTRIES = 4_000_000

# Rows per chunk of vectors and per pack of queries in the joined scoring path.
CHUNK_ROWS = 2048
PACK_QUERIES = 256

# Literal cell lists longer than this are not turned into partition filters.
PRUNE_CELLS = 4096

# Offsets of so many files or splits (about 200 bytes each) are broadcast.
BROADCAST_FILES = 200_000

# Splits of CSV files whose beginnings (about 100 bytes each) go to every task.
CSV_SPLITS = 1_000_000

# Assumed number of scan tasks where Spark doesn't know the size of a table.
MANY_TASKS = 100_000

# Longer IN lists become a left-semi join.
IN_LIST_LITERALS = 1000


def rows_within(limit_bytes: int, bytes_per_row: int) -> int:
    return max(1, int(limit_bytes // max(1, bytes_per_row)))
