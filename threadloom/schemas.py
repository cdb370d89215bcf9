"""Explicit schemas, so that an empty input gives an empty, typed output."""

POST = """
    thread_id STRING, title STRING, text STRING, author STRING, score BIGINT,
    num_comments BIGINT, subreddit STRING, url STRING
"""

COMMENT = """
    id STRING, thread_id STRING, subreddit STRING, parent_id STRING,
    is_root_comment BOOLEAN, author STRING, body STRING, score BIGINT, depth INT,
    replies_count BIGINT, created_utc DOUBLE, created_at STRING
"""

TOPIC_SUMMARY = """
    thread_id STRING, cluster INT, keywords STRING, upvotes BIGINT,
    participants BIGINT, polarization DOUBLE, sentiment DOUBLE, popular STRING,
    core STRING, dissent STRING
"""
