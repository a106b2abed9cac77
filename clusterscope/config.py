"""Parameters and fixed values.

Values in the FIXED VALUES blocks must equal the behaviour being matched
(weights, boosts, thresholds, word lists); everything else is a tunable.
"""

from __future__ import annotations

import string

# ---------------------------------------------------------------------------
# FIXED VALUES — similarity weights and clustering / labelling constants
# ---------------------------------------------------------------------------
# weight of url, title, fulltext, plaintext similarity in the page distance
SIM_WEIGHTS = {"url": 0.05, "title": 0.25, "fulltext": 0.2, "plaintext": 0.5}
SIM_FIELDS = ("url", "title", "fulltext", "plaintext")

# search fields and their boosts: title^3.0 plaintext^2 fulltext^0.5
FIELD_BOOSTS = {"title": 3.0, "plaintext": 2.0, "fulltext": 0.5}
SEARCH_FIELDS = ("title", "plaintext", "fulltext")

# BM25 (Lucene 7 form, the (k1 + 1) factor included)
BM25_K1 = 1.2
BM25_B = 0.75

# default number of hits a search returns
TOP_K = 10

# DBSCAN
DBSCAN_EPS = 0.4
DBSCAN_MIN_SAMPLES = 2

# linkage flat cut: inconsistency threshold and depth
LINKAGE_T = 0.4
LINKAGE_DEPTH = 5
LINKAGE_DEFAULT_METHOD = "ward"

# HDBSCAN defaults
HDBSCAN_MIN_CLUSTER_SIZE = 5
HDBSCAN_MIN_SAMPLES = 5

# affinity propagation defaults
AP_DAMPING = 0.5
AP_MAX_ITER = 200
AP_CONVERGENCE_ITER = 15

# RAKE labels
RAKE_MAX_CHARS = 10000
RAKE_MAX_PHRASES = 20
LABEL_APPROX_CHARS = 50
LABEL_CLEAN_PATTERN = r"(^,+)|(,+$)|([^0-9A-Za-z]+,+)"

# LSA
LSA_TOPICS = 150
LSA_BLUR_CUTOFF = 0.1

# algorithm names accepted by the dispatchers
CLUSTER_ALGORITHMS = (
    "dbscan", "hdbscan", "linkage-single", "linkage-complete", "linkage-average",
    "linkage-weighted", "linkage-centroid", "linkage-median", "linkage-ward",
    "affinity_propagation",
)
SUMMARY_ALGORITHMS = ("rake",)
RANK_ALGORITHMS = ("max_score", "median_score", "sum_score")
DEFAULT_CLUSTER_ALG = "dbscan"
DEFAULT_SUMMARY_ALG = "rake"
DEFAULT_RANK_ALG = "max_score"

# ---------------------------------------------------------------------------
# FIXED VALUES — English stopwords used by the keyphrase extractor
# (the public NLTK English list, 179 words, in its natural order)
# ---------------------------------------------------------------------------
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn "
    "couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't "
    "isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# single punctuation characters ignored by the keyphrase extractor
PUNCTUATION = tuple(string.punctuation)

# ---------------------------------------------------------------------------
# FIXED VALUES — HTML entities decoded by the text extractors (``&amp;`` last)
# ---------------------------------------------------------------------------
HTML_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"),
    ("&amp;", "&"),
)

# block-level tags: a new one ends an open paragraph / heading
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p",
    "pre", "section", "table", "td", "th", "title", "tr", "ul",
)
# tags whose text is extracted as page plaintext
TEXT_TAGS = ("title", "h1", "h2", "h3", "h4", "h5", "h6", "p")
