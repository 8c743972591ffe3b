"""Pieces of SQL that several oracle statements share."""

TOKENS = r"regexp_extract_all(replace(regexp_replace(replace(lower({0}), '’', ''''), '''s\b', '', 'g'), '''', ''), '[a-z0-9]+')"
C = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"
U = "u AS (SELECT * FROM utterances QUALIFY row_number() OVER (PARTITION BY file_id, idx ORDER BY ingested_at DESC) = 1)"
H = "h AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY logged_at DESC) = 1)"
A = "a AS (SELECT * FROM audio_files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1)"
S = "s AS (SELECT DISTINCT file_id, label, role, name FROM speakers)"


def tok(x: str) -> str:
    return TOKENS.format(x)


def stop_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def content(toks: str, stop: str) -> str:
    return f"list_filter({toks}, lambda x: len(x) >= 3 AND NOT list_contains({stop}, x) AND NOT regexp_full_match(x, '[0-9]+'))"
