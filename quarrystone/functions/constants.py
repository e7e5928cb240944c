"""Fixed values of the catalog: word lists, patterns, schemas and thresholds.

These must stay as they are for results to agree; the sets of missing markers differ on purpose,
as each operator compares against its own.
"""

from __future__ import annotations

# Missing markers of catalog cells, compared as they are.
MISSING_CELL = (
    "", "[missing]", "unknown", "n/a", "not found", "not specified", "not available", "not mentioned", "none", "missing", "nan", "null",
    "[implausible]", "[error]", "[stability_error]", "[timeout_error]", "[server_error]", "[retrieval_error]", "[extraction_error: dict_returned]", "[extraction_error: complex_string]",
)
# Missing markers of entity resolution, lower-cased before comparison.
MISSING_ENTITY = ("", "nan", "none", "[missing]", "[skipped]", "unknown", "n/a", "null")
# Names that name nothing.
INVALID_NAMES = ("", "[missing]", "unknown", "n/a", "nan", "none", "dataset", "time series", "time series dataset", "various", "varies", "null")
INVALID_NAMES_DOCTOR = ("", "[missing]", "missing", "unknown", "n/a", "nan", "none", "dataset", "time series", "time series dataset", "various", "varies", "null")
# Missing markers of the planner.
MISSING_PLANNER = ("", "[missing]", "nan", "none")
# Normal form and its markers in scoring.
NOT_SPECIFIED = "not specified"
NOT_SPECIFIED_MARKERS = ("", "nan", "none", "not specified")

# Words that say nothing in a name.
STOP_WORDS = ("dataset", "data", "benchmark", "collection", "repository", "archive", "series", "time", "prediction", "forecasting", "competition")
# Parts of URLs that many entities share.
GENERIC_URLS = ("search", "query", "google.com", "bing.com", "kaggle.com", "archive.ics.uci.edu", "zenodo.org", "github.com", "timeseriesclassification.com", "huggingface.co", "hf.co")
# Tokens that tell variants of one family apart.
DISCRIMINATORS = (
    "france", "belgium", "germany", "spain", "italy", "uk", "usa", "china", "japan", "australia", "nord", "pjm", "california", "texas", "ny", "london", "ottawa", "halifax",
    "hourly", "daily", "weekly", "monthly", "yearly", "minute", "second", "test", "train", "val", "validation", "small", "large", "full", "subset",
    "np", "de", "fr", "be", "es", "it", "pems03", "pems04", "pems07", "pems08", "m1", "m3", "m4", "m5", "gef12", "gfc12", "gfc14", "gfc17",
)

# Scope of dataset names.
OUT_OF_SCOPE_SUFFIXES = (".py", ".xlsx", ".csv", ".md", ".txt")
OUT_OF_SCOPE_NAMES = ("pascal voc", "titanic", "shopee", "imagenet", "cifar", "mnist")

# Classes of entities by name.
LEAF_PATTERNS = (r"\bett[hm]\d\b", r"\bpems[-_ ]?(sf|bay|0)\b", r"san francisco traffic", r"traffic \(pems\)", r"\becl\b", r"electricity consuming load", r"exchange rate", r"illness", r"weather \(mpi", r"taxi", r"solar")
EXACT_COLLECTIONS = ("pems", "ett", "monash", "utsd", "tslib", "m3", "m4", "m5", "gefcom", "lotsa", "timebench", "chronos", "gluonts", "timeseriesclassification")
COLLECTION_KEYWORDS = ("archive", "repository", "library", "collection", "benchmark", "corpus", "unified time series", "benchmark suite", "competition", "dataset suite")
PROVIDER_KEYWORDS = ("ecmwf", "bank", "reserve", "authority", "commission", "physionet", "kaggle", "caltrans", "nrel", "noaa", "google", "microsoft", "uci")

# Name cleaning, in order; the suffix needs a separator or the end behind it.
NAME_PATTERNS = (
    r"^thuml/", r"^google/", r"^microsoft/", r"^facebook/", r"^ucr/",
    r"\s*\((?:.*\bUTSD\b.*)\)", r"\s*\((?:.*\bTimer\b.*)\)",
    r"\s*\(Component\)", r"\s*\(Subset\)", r"\s*\(Collection\)",
    r"[-_ ](small|medium|large|tiny|full|subset|complete|12g|1g|4g)(?=[-_ ]|$)",
)
# Domains that no cell may link to, and domains of papers.
BANNED_DOMAINS = ("vertexaisearch.cloud.google.com", "grounding-api-redirect", "scholar.google")
PAPER_DOMAINS = (
    "arxiv.org", "doi.org", "researchgate.net", "ieeexplore.ieee.org", "sciencedirect.com", "springer.com", "nature.com", "acm.org", "semanticscholar.org",
    "vertexaisearch.cloud.google.com", "grounding-api-redirect",
)

# Plausible ranges of numeric fields.
PLAUSIBLE = {"Variables per Location": (1, 50000), "Number of Locations/Series": (1, 10000000), "Number of Time Points": (1, 100000000), "Total Variables": (1, 1000000000)}
GROUNDING_FIELDS = ("Primary Source Repository", "Primary URL", "Link to Data (Actual Source)", "Other URL", "Comments on Data Preparation")
URL_FIELDS = ("Link to Data (Actual Source)", "Primary URL", "Other URL", "URL")

# Where a model's answer turns into thoughts of its own, and its fenced part.
ANSWER_ENDS = (r"\n\s*thought\b", r"\n\s*Wait, I noticed", r"======")
ANSWER_FENCE = r"```(?:json)?\n(.*?)\n```"
# Notes of the audit's log.
AUDIT_FILLED, AUDIT_ADDED, AUDIT_REPLACED, AUDIT_UPGRADED = "Filled {}", "Added {}", "Replaced {} with longer text", "Upgraded {}"
AUDIT_NOTES = 5
# Columns that an audit adds to.
AUDIT_ADDITIVE = ("Description", "Assignment Rationale", "Project Citations", "Project WebLinks", "Primary URL", "Link to Data (Actual Source)", "Other URL")

# Thresholds.
LOCK = 0.95
GATE = 0.40
QUARANTINE = 0.50
LOW = 0.80
AUTO_KEEP = 0.98
JOB_SECONDS = 14_400

# Report column to knowledge-base column.
SCHEMA_MAP = {
    "Dataset Name": "Variant Name",
    "Detailed Description": "Description",
    "Time interval between points": "Frequency",
    "Number of Time Points": "Num Time Points",
    "Number of Locations/Series": "Num Locations/Series",
    "Primary Source Repository": "Primary Creator",
    "Canonical Name": "Canonical Name",
    "Aliases": "Aliases",
    "Type": "Type",
    "Total Variables": "Total Variables",
    "Variables per Location": "Variables per Location",
    "Domain": "Domain",
    "Primary URL": "Primary URL",
    "Link to Data (Actual Source)": "Link to Data (Actual Source)",
    "Other URL": "Other URL",
}
# Projects of the benchmark matrix, in order of precedence.
PROJECTS = ("UTSD", "TIMEBENCH", "LOTSA", "TEMPO", "TSFM", "KAGGLETS", "M2", "M6")
CONTEXTS = ("32K", "64K", "131K")

# Columns of the knowledge-base tabs.
_DATASETS = [
    "DatasetID", "Canonical Name", "Variant Name", "Aliases", "Type", "Num Time Points", "Num Time Points (C)", "Num Locations/Series", "Num Locations/Series (C)",
    "Total Variables", "Total Variables (C)", "Variables per Location", "Variables per Location (C)", "Frequency", "Frequency (C)", "Domain", "Domain (C)", "Description", "Primary Creator",
    "Primary URL", "Primary URL (C)", "Link to Data (Actual Source)", "Link to Data (Actual Source) (C)", "Other URL", "Other URL (C)", "License", "Overall Confidence",
    "Job_Created", "Date_Created", "Project_Created", "Job_Updated", "Date_Updated", "Project_Updated",
]
_LINKS = ["LinkID", "ProjectID", "DatasetID", "Actual Data URL Used", "Data Preparation Comments", "CitationID", "Assignment Confidence", "Link_Date", "Linked_By_Job"]
TABS = {
    "Jobs": ["JobID", "ProjectID", "Mode", "Start_Time", "End_Time", "Duration_Sec", "Status", "Items_Found", "Operational_Parameters", "JOB_COMMENT"],
    "Datasets": _DATASETS,
    "Projects": ["ProjectID", "Name", "Description", "Type", "Last Analyzed", "Source URL"],
    "Project_Dataset_Link": _LINKS,
    "Datasets_Quarantined": _DATASETS,
    "Links_Quarantined": _LINKS,
    "Datasets_Duplicates_Log": ["DatasetID (Dropped)", "DatasetID (Kept)", "Reason", "Merge Notes", "Dropped Name", "Kept Name"],
    "Citations": ["CitationID", "Title", "Authors", "Venue", "Year", "DOI", "URL", "Full Citation Text"],
    "WebLinks": ["WebLinkID", "URL", "Resource Type", "Description"],
}
