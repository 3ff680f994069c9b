"""Fixed values of the store, search, curation and evaluation, in one place."""

DIMS = 384
EMBED_CLIP = 1500
EMBED_BATCH = 32
CONTENT_CLIP = 8000
LIMIT = 5
MIN_SCORE = 0.0
SELF_PENALTY = 0.15
PAIR_ANSWER_CLIP = 700
PAIR_QUESTION_CLIP = 200
FACT_BOOST = 0.06
PIN_BOOST = 0.05
FACT_RELIEF = 0.05
LABEL_WEIGHT = 0.01
LABEL_MIN, LABEL_MAX = -2, 4
FACT_CLIP = 500
MERGE_SIMILARITY = 0.92
NEAR_SIMILARITY = 0.86
RECURRENCE_SIMILARITY = 0.86
RECURRENCE_K = 8
RECURRENCE_SESSIONS = 2
DISTILL_MIN, DISTILL_MAX = 80, 4000
DISTILL_LIMIT = 50
SEED_MIN, SEED_MAX = 40, 400
SESSION_PAGE = 50
CATCH_UP_DAYS = 7
SUMMARY_CLIP = 480
LOW_USER, LOW_OTHER, LOW_NARRATION = 25, 100, 300
HOOK_LIMIT, HOOK_MIN_SCORE, HOOK_CHARS, HOOK_SNIPPET = 3, 0.75, 2000, 700
LOG_KEEP = 20_000
LOG_QUERY_CLIP = 2000
SYNC_PAGE = 500
F_BETA2 = 0.25


def turn_pool(limit: int) -> int:
    """How many turns a search fetches before filters and one-a-session thin them."""
    return max(limit * 6, 24)


def fact_pool(limit: int) -> int:
    """How many facts a search fetches."""
    return max(limit * 2, 8)
