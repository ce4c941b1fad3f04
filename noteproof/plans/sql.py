"""Pieces of oracle SQL that several queries share."""

from __future__ import annotations

from ..functions import text as T
from ..functions.text import STOPWORDS

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"

#: A table ``t`` of item_id and the distinct terms of its text.
TERMS_SQL = (
    "t AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_.-]{3,}')) AS term FROM benchmark) "
    f"WHERE NOT list_contains({STOP_SQL}, lower(term)))"
)


def tokens_sql(text: str) -> str:
    """The distinct words of a text and their parts."""
    return (
        f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array({text}, '[^A-Za-z0-9_.-]+'), lambda w: w <> ''), "
        f"lambda w: list_concat(list_filter([lower(w)], lambda x: length(x) >= 2 AND NOT list_contains({STOP_SQL}, x)), "
        f"list_filter(list_transform(regexp_split_to_array(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+'), lambda p: lower(p)), "
        f"lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x))))))"
    )


#: Paths of every kind, for queries on file kinds.
SHAPES = [
    "docs/a.md", "docs/conf.py", "web/CHANGELOG", "LICENSE", "feed.xml", "go.mod", "go.sum", "pyproject.toml", "requirements-dev.txt", "x/build.gradle", "a/package.json", "tests/a.py",
    "src/b_test.go", "tests/.github/workflows/ci.yml", ".github/workflows/x.yml", "Dockerfile.dev", "x/setup.py", "db/migrations/1.py", "sql/V2__a.sql", "q/a.sql", "img/a.png", "img/a.svg",
    "lib/a.so", "conf/x.yaml", ".mcp.json", "data/x.json", "src/oauth_login.rs", "src/policy.rs", "src/vault.go", "src/tokenizer.rs", "src/token_store.rs", "docs/auth.md", "AUTHORS", "src/main.rs",
    "lib/g.c", "spec/login_spec.rb", "a/yarn.lock",
]
SHAPES_SQL = "[" + ", ".join(f"'{x}'" for x in SHAPES) + "]"


def matches_sql(column: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


def category_sql(path: str) -> str:
    """The kind of a file, its patterns evaluated by the other engine."""
    return (
        f"CASE WHEN {matches_sql(path, T.DOC_FILE, T.CHANGELOG, T.PROJECT_META, T.SITE_METADATA)} THEN 'docs' WHEN {matches_sql(path, T.DEPENDENCY_MANIFEST)} THEN 'dependencies' "
        f"WHEN {matches_sql(path, T.TEST_FILE)} THEN 'tests' WHEN {matches_sql(path, T.CI_BUILD)} THEN 'ci/build' WHEN {matches_sql(path, T.MIGRATION_FILE)} THEN 'migrations' "
        f"WHEN {matches_sql(path, T.BENIGN_BINARY, T.OPAQUE_BINARY)} THEN 'assets' WHEN {matches_sql(path, T.CONFIG_FILE)} THEN 'config' ELSE 'source' END"
    )


def sensitive_sql(path: str) -> str:
    """The sensitive kind of a file or null; that engine has no look-ahead, so tokenizers are masked first."""
    masked = f"regexp_replace({path}, '(?i)token(i[sz])', '~\\1', 'g')"
    secret = T.AUTH_CRYPTO.replace("token(?!i[sz])", "token")
    return (
        f"CASE WHEN {matches_sql(path, T.DEPENDENCY_MANIFEST)} THEN 'dependencies' WHEN {matches_sql(path, T.DOC_FILE, T.PROJECT_META, T.SITE_METADATA, T.CHANGELOG)} THEN NULL "
        f"WHEN {matches_sql(path, T.CI_BUILD)} THEN 'ci/build' WHEN {matches_sql(path, T.TEST_FILE)} THEN NULL WHEN {matches_sql(masked, secret)} THEN 'auth/crypto' END"
    )
