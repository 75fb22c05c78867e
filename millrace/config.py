"""Engine settings: one frozen dataclass per concern, defaults fixed by the feature's contract."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------------
# Enumerations and lookup tables whose spelling and numbers are part of the contract.
# ---------------------------------------------------------------------------------------------

ORIGINS = ("manual", "good", "saved", "read_full", "clicked")
OWNED_ORIGINS = ("manual", "good", "saved")
READ_ORIGINS = ("read_full", "clicked")
ACTIONS = ("good", "bad", "save")
POSITIVE_ACTIONS = ("good", "save")
CONTENT_TYPES = ("concept", "implementation", "research", "news")
DIFFICULTIES = ("beginner", "intermediate", "advanced")
SLOTS = ("strong_interest", "primary_source", "exploration", "diversity")

# Duplicate evidence, strongest first; the position is the stage code.
MATCH_METHODS = ("canonical_url", "normalized_url", "body_hash", "title", "embedding")

# Tier per source type; tiers 1 and 2 are primary sources.
SOURCE_TIERS = {
    "official_documentation": 1,
    "api_specification": 1,
    "standard_specification": 1,
    "official_release_notes": 1,
    "official_blog": 2,
    "official_research": 2,
    "original_paper": 2,
    "official_github_release": 2,
    "company_tech_blog": 3,
    "maintainer_article": 3,
    "personal_article": 4,
    "tech_media": 4,
    "news_repost": 5,
    "summary_repost": 5,
    "unknown": 5,
}
PRIMARY_MAX_TIER = 2

# Authority score per source type.
AUTHORITY_BY_TYPE = {
    "official_documentation": 1.00,
    "api_specification": 1.00,
    "standard_specification": 1.00,
    "official_release_notes": 1.00,
    "official_research": 0.95,
    "original_paper": 0.95,
    "official_blog": 0.90,
    "official_github_release": 0.90,
    "company_tech_blog": 0.75,
    "maintainer_article": 0.60,
    "personal_article": 0.60,
    "tech_media": 0.45,
    "news_repost": 0.20,
    "summary_repost": 0.20,
    "unknown": 0.35,
}
UNKNOWN_AUTHORITY = 0.35

# Listed domains used when no registry rule matches.
FALLBACK_DOMAINS = {
    "zenn.dev": "personal_article",
    "qiita.com": "personal_article",
    "note.com": "personal_article",
    "hatenablog.com": "personal_article",
    "hatenadiary.jp": "personal_article",
    "medium.com": "personal_article",
    "dev.to": "personal_article",
    "substack.com": "personal_article",
    "speakerdeck.com": "personal_article",
    "b.hatena.ne.jp": "summary_repost",
    "news.ycombinator.com": "summary_repost",
    "reddit.com": "summary_repost",
    "publickey1.jp": "tech_media",
    "itmedia.co.jp": "tech_media",
    "atmarkit.itmedia.co.jp": "tech_media",
    "gihyo.jp": "tech_media",
    "codezine.jp": "tech_media",
    "thinkit.co.jp": "tech_media",
    "techcrunch.com": "tech_media",
    "theverge.com": "tech_media",
    "arstechnica.com": "tech_media",
    "infoq.com": "tech_media",
    "thenewstack.io": "tech_media",
    "venturebeat.com": "news_repost",
    "zdnet.com": "news_repost",
}
FALLBACK_HOST_PREFIXES = ("engineering", "developer", "developers", "devblog", "tech")
FALLBACK_PATH_HINTS = ("/engineering", "/engineering-blog", "/tech-blog", "/techblog")

# Reason phrases per score component: (form used before another phrase, closing form).
REASON_PHRASES = {
    "interest_similarity": ("関心との一致度が高く", "関心との一致度が高い"),
    "source_authority": ("情報源の権威性が高く", "情報源の権威性が高い"),
    "source_article_match": (
        "情報源と記事の主題が一致しており",
        "情報源と記事の主題が一致している",
    ),
    "freshness": ("公開から日が浅く", "公開から日が浅い"),
    "technical_quality": ("技術的な質が高く", "技術的な質が高い"),
    "novelty": ("新規性が高く", "新規性が高い"),
}
REASON_CLOSING = "ため、上位に表示しています。"
FALLBACK_CLUSTER_LABEL = "未分類クラスタ #"

# Search-query suffixes per language; other languages get the bare terms.
QUERY_SUFFIXES = {"ja": ("解説", "入門"), "en": ("guide", "release")}


# ---------------------------------------------------------------------------------------------
# Tunable settings
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ScoreWeights:
    interest_similarity: float = 0.35
    source_authority: float = 0.30
    source_article_match: float = 0.10
    freshness: float = 0.10
    technical_quality: float = 0.10
    novelty: float = 0.05


@dataclass(frozen=True)
class FeedbackWeights:
    manual: float = 1.0
    good: float = 0.8
    save: float = 0.5
    read_full: float = 0.2
    clicked: float = 0.1
    bad: float = 0.8

    def by_origin(self) -> dict[str, float]:
        """Explicit weight of each origin (a saved article weighs as much as a save)."""
        return {
            "manual": self.manual,
            "good": self.good,
            "saved": self.save,
            "read_full": self.read_full,
            "clicked": self.clicked,
        }


@dataclass(frozen=True)
class DecaySettings:
    """Recent-window rule that turns repeated Bad feedback into a negative weight."""

    recent_window: int = 5
    bad_threshold: int = 3
    decay_step: float = 0.2


@dataclass(frozen=True)
class Composition:
    strong_interest: float = 0.55
    primary_source: float = 0.25
    exploration: float = 0.15
    diversity: float = 0.05
    strong_interest_min_similarity: float = 0.5
    exploration_min_novelty: float = 0.5

    def ratios(self) -> dict[str, float]:
        return {
            "strong_interest": self.strong_interest,
            "primary_source": self.primary_source,
            "exploration": self.exploration,
            "diversity": self.diversity,
        }


@dataclass(frozen=True)
class Clustering:
    min_clusters: int = 2  # guidance for choosing the others; no rule reads it
    max_clusters: int = 8
    min_articles_per_cluster: int = 3
    label_topic_count: int = 3
    seed: int = 0
    restarts: int = 10
    max_iterations: int = 300
    local_rows: int = 10_000  # articles of a user that one task clusters; more are clustered by all tasks together


@dataclass(frozen=True)
class Dedup:
    title_similarity: float = 0.90
    embedding_similarity: float = 0.92
    penalty_canonical_url: float = 1.0
    penalty_normalized_url: float = 1.0
    penalty_body_hash: float = 1.0
    penalty_title: float = 0.8
    penalty_embedding: float = 0.6
    unique_content_types: tuple[str, ...] = ("implementation", "research")
    unique_min_quality: float = 0.70
    unique_max_authority_gap: float = 0.30
    unique_per_cluster: int = 2
    lookback_days: int = 7
    # None switches the per-run safety cap off (the single-machine default was 500).
    max_articles_per_run: int | None = None
    # None: every candidate is judged; a number is a stated budget for one run.
    max_judge_calls: int | None = None

    def penalties(self) -> dict[str, float]:
        return {
            "canonical_url": self.penalty_canonical_url,
            "normalized_url": self.penalty_normalized_url,
            "body_hash": self.penalty_body_hash,
            "title": self.penalty_title,
            "embedding": self.penalty_embedding,
        }


@dataclass(frozen=True)
class FeedLifecycle:
    max_failures: int = 3
    max_empty_fetches: int = 10
    max_no_new_entries: int = 30
    retry_days: int = 30
    max_feeds: int = 20
    domains_per_run: int = 5
    links_per_domain: int = 5


@dataclass(frozen=True)
class EngineConfig:
    """All settings of the engine; pass a changed copy (``dataclasses.replace``) to any job."""

    weights: ScoreWeights = field(default_factory=ScoreWeights)
    feedback: FeedbackWeights = field(default_factory=FeedbackWeights)
    topic_decay: DecaySettings = field(default_factory=DecaySettings)
    source_decay: DecaySettings = field(default_factory=lambda: DecaySettings(decay_step=1.0))
    composition: Composition = field(default_factory=Composition)
    clustering: Clustering = field(default_factory=Clustering)
    dedup: Dedup = field(default_factory=Dedup)
    feeds: FeedLifecycle = field(default_factory=FeedLifecycle)

    bad_penalty: float = 1.0
    read_penalty: float = 0.3
    gate_min_similarity: float = 0.35
    gate_min_factor: float = 0.2
    max_age_days: float = 7
    top_k: int = 3
    # None: the whole history of a user.
    max_profile_articles: int | None = None
    max_bad_articles: int | None = None
    partial_match_score: float = 0.5
    novelty_default: float = 0.5
    source_pref_scale: float = 0.15
    source_pref_min: float = 0.5
    source_pref_max: float = 1.5
    bad_min_similarity: float = 0.7
    bad_max_penalty: float = 0.5
    half_life_days: float = 30.0
    confidence_embedding: float = 0.4
    confidence_topics: float = 0.3
    confidence_analyzed: float = 0.3
    confidence_floor: float = 0.3

    # None: every eligible article of the pool is scored and ranked for every user.
    max_candidates: int | None = None
    feed_size: int = 100
    related_size: int = 20
    timeline_weeks: int = 12
    summary_limit: int = 20

    freshness_days: int = 7
    # None: no cap.
    max_crawl_candidates: int | None = None
    max_queries: int = 10
    interest_source_articles: int = 20
    hacker_news_top_items: int | None = None
    max_url_length: int = 2048

    log_retention_days: int = 90
    run_retention_days: int = 30
    throttle_max_requests: int = 30
    throttle_window_seconds: int = 60

    # Physical limits of one Arrow task.  They bound memory, never the result.
    vector_tile_rows: int = 2048
    title_block_rows: int = 4096


DEFAULT = EngineConfig()
