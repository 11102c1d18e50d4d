"""Fixed values the operators must share with the tool whose behaviour we
reproduce.  They are stated plainly, in their natural order, so that results
line up exactly; nothing here is computed.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the reproduced tool's lists)
# ---------------------------------------------------------------------------

# Extension families used by the sort verb (type detection, mixed sort).
DOCUMENT_EXTS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
                 ".txt", ".rtf", ".csv", ".odt", ".ods", ".odp")
MUSIC_EXTS = (".mp3", ".flac", ".wav", ".aac", ".ogg", ".wma", ".m4a", ".aiff", ".alac")
PICTURE_EXTS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".raw",
                ".psd", ".ai", ".heic", ".heif", ".cr2", ".nef", ".orf", ".sr2", ".dng")
VIDEO_EXTS = (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".3gp")

# Picture sort: design files and the (different) image list.
DESIGN_EXTS = (".psd", ".psb", ".ai", ".indd", ".svg")
IMAGE_EXTS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif",
              ".webp", ".heic", ".heif", ".raw", ".cr2", ".nef", ".orf", ".sr2", ".dng")

# Document sort: top-folder substrings, checked in this order.
PROFESSIONNEL_PATTERNS = ("sofitel", "presentation rh", "sem", "thiercelin", "vivawere",
                          "budget", "ceg", "fiscalite", "fiscalité")
PERSONNEL_PATTERNS = ("desktop", "downloads", "mes documents", "omar", "nm", "divers",
                      "a_trier", "documents")
RESSOURCES_PATTERNS = ("pdf", "zips", "a_renommer", "onedrive")

# Video sort: dashcam name pattern and source-folder lookups.
DASHCAM_REGEX = r"^N_[0-9]{8}_[0-9]{6}\.mp4$"  # matched case-insensitively
FILM_SOURCES = ("_from_movie", "_from_films", "_from_movies", "_from_film", "_from_ro", "_from_f03")
WHATSAPP_SOURCE = "_from_whatsapp video"
FAMILLE_SOURCES = ("_from_pellicule", "_from_videos", "_from_vidéos",
                   "_from_home videos", "_from_attachments", "_from_sent")

# Consolidate extension presets.
PRESETS = {
    "documents": (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
                  ".txt", ".rtf", ".odt", ".ods", ".odp", ".csv", ".tsv"),
    "music": (".mp3", ".m4a", ".flac", ".wma", ".aac", ".ogg", ".wav"),
    "pictures": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif",
                 ".heic", ".webp", ".svg", ".raw", ".cr2", ".nef"),
    "videos": (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm",
               ".m4v", ".mpg", ".mpeg", ".3gp"),
    "email": (".pst", ".ost", ".msg", ".eml"),
}

# Directory names skipped by each verb.
DEDUP_SKIP_DIRS = (".git", "__pycache__", "node_modules", ".DS_Store",
                   "System Volume Information", "$RECYCLE.BIN", ".Trash-*")
SNAPSHOT_SKIP_DIRS = (".git", ".svn", ".hg", "node_modules", "__pycache__",
                      ".venv", "venv", ".pytest_cache", ".tox")
CONSOLIDATE_SKIP_DIRS = ("$RECYCLE.BIN", "System Volume Information", ".Trash-*",
                         "__pycache__", ".git", "node_modules", ".vscode", ".idea")

# Protected directory substrings (a dir is protected if its name contains one).
CLEAN_PROTECTED = ("$RECYCLE.BIN", "System Volume Information", ".git")
RENAME_PROTECTED = ("$RECYCLE.BIN", "System Volume Information", ".git", "Ops", "handoff-archive")

# Junk-file globs (clean verb).
JUNK_PATTERNS = ("desktop.ini", "Desktop.ini", "Thumbs.db", "thumbs.db", ".DS_Store",
                 "ntuser.ini", "ntuser.dat*", "NTUSER.DAT*", "~$*", "~WRL*.tmp",
                 "~WRF*.tmp", "*.tmp", ".~lock.*")

# Keeper scoring (dedup): copy markers looked for in the lower-cased name,
# and the UUID pattern looked for in the lower-cased whole path.
COPY_MARKERS = ("copy of ", " - copy", " - copie", " - copy (", "(1)", "(2)", "(3)")
UUID_REGEX = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"

# Rename verb: copy-name patterns (ASCII digits).
COPY_NUMBER_REGEX = r" \(([0-9]+)\)\."
COPY_SUFFIX_REGEX = r" - Cop(?:y|ie)(?: \([0-9]+\))?\."

# Staging (consolidate): parents that are too generic to name a source alone.
GENERIC_PARENTS = ("source", "files", "data")

# Year window accepted when a year is read from a file name.
YEAR_MIN, YEAR_MAX = 1990, 2030

# Defaults.
DEDUP_MIN_SIZE = 1024
CONSOLIDATE_MIN_SIZE = 100
BATCH_SIZE = 500
MAX_SAMPLES = 3
LARGEST_FILES = 50
EMPTY_DIR_MAX_PASSES = 10
NTFS_DEFAULT_ID = 1000
