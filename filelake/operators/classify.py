"""Content-type detection and classification into categories (AG6, CL1-CL5,
PF14-PF18).  Every rule is a Column expression: CASE over extension lists,
folder-name substrings and regexes -- no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake import constants as C
from filelake.functions import paths as P

TYPES = ("documents", "music", "pictures", "videos")


def family(ext: Column) -> Column:
    """Extension family used by detection and the mixed sort."""
    return (F.when(ext.isin(list(C.DOCUMENT_EXTS)), "documents")
             .when(ext.isin(list(C.MUSIC_EXTS)), "music")
             .when(ext.isin(list(C.PICTURE_EXTS)), "pictures")
             .when(ext.isin(list(C.VIDEO_EXTS)), "videos"))


def detect_type(files: DataFrame) -> DataFrame:
    """AG6: one row with the count per family, their total and the detected
    type -- a family holding strictly more than 80 % of recognised files,
    else 'mixed' (also when nothing is recognised).  ``files`` needs ``ext``."""
    fam = family(F.col("ext"))
    counts = files.agg(*[F.count_if(fam == t).alias(t) for t in TYPES])
    total = sum((F.col(t) for t in TYPES[1:]), F.col(TYPES[0]))
    detected = None
    for t in TYPES:
        cond = (F.col("total") > 0) & ((F.col(t) / F.col("total")) > 0.8)
        detected = F.when(cond, t) if detected is None else detected.when(cond, t)
    return counts.withColumn("total", total).withColumn("detected_type", detected.otherwise("mixed"))


# --- per-type categories ---------------------------------------------------------

def mixed_category(ext: Column) -> Column:
    """CL1."""
    return (F.when(ext.isin(list(C.DOCUMENT_EXTS)), "Documents")
             .when(ext.isin(list(C.MUSIC_EXTS)), "Music")
             .when(ext.isin(list(C.PICTURE_EXTS)), "Pictures")
             .when(ext.isin(list(C.VIDEO_EXTS)), "Videos")
             .otherwise("_Misc"))


def _contains_any(s: Column, needles) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | s.contains(n)
    return cond


def document_folder_category(top: Column) -> Column:
    """CL2 folder rule on the first-level folder ('' for root-level files)."""
    low = F.lower(top)
    return (F.when(_contains_any(low, C.PROFESSIONNEL_PATTERNS), "05_Professionnel")
             .when(_contains_any(low, C.PERSONNEL_PATTERNS), "07_Personnel")
             .when(_contains_any(low, C.RESSOURCES_PATTERNS), "06_Ressources_et_Documentation")
             .when(top.rlike(r"^_from_[0-9]+$"), "07_Personnel")
             .otherwise("_Unclassified"))


def documents_category(ext: Column, top: Column) -> Column:
    """CL2: document extensions or no extension; NULL = not sorted."""
    return F.when(ext.isin(list(C.DOCUMENT_EXTS)) | (ext == ""),
                  document_folder_category(F.coalesce(top, F.lit(""))))


def artist_display(artist: Column) -> Column:
    """PF16: '/' and '\\' become '_'; empty -> NULL."""
    return F.when(artist != "", F.translate(artist, "/\\", "__"))


def music_category(ext: Column, artist: Column, parent_name: Column) -> Column:
    """CL3: artist, else '_Various/<Title>' from a '_from_x' parent, else '_Unknown'."""
    various = F.when(parent_name.startswith("_from_"),
                     F.concat(F.lit("_Various/"), P.python_title(parent_name.substr(F.lit(7), F.lit(1 << 30)))))
    return F.when(ext.isin(list(C.MUSIC_EXTS)),
                  F.coalesce(artist_display(artist), various, F.lit("_Unknown")))


def _year_in_window(y: Column) -> Column:
    return F.when(y.between(C.YEAR_MIN, C.YEAR_MAX), y)


def year_from_name(name: Column) -> Column:
    """PF14: leading YYYYMMDD; then IMG/VID/PHOTO_YYYYMMDD (any case); then the
    first YYYY-MM-DD / YYYY_MM_DD; each only inside 1990..2030."""
    p1 = F.regexp_extract(name, r"^([0-9]{4})[0-9]{4}", 1).try_cast("int")
    p2 = F.regexp_extract(name, r"(?i)^(?:IMG|VID|PHOTO)_([0-9]{4})[0-9]{4}", 1).try_cast("int")
    p3 = F.regexp_extract(name, r"([0-9]{4})[-_][0-9]{2}[-_][0-9]{2}", 1).try_cast("int")
    return F.coalesce(_year_in_window(p1), _year_in_window(p2), _year_in_window(p3))


def year_from_exif(exif_date: Column) -> Column:
    """PF15: 'YYYY:MM:DD...' -> YYYY; year 0 counts as none; no range check."""
    y = F.regexp_extract(exif_date, r"^([0-9]{4}):([0-9]{2}):([0-9]{2})", 1).try_cast("int")
    return F.when(y != 0, y)


def pictures_category(ext: Column, name: Column, exif_date: Column | None) -> Column:
    """CL4: design files -> '_Design'; images -> year (EXIF, then name) or
    '_Undated'; anything else is not sorted."""
    exif = year_from_exif(exif_date) if exif_date is not None else F.lit(None).cast("int")
    year = F.coalesce(exif, year_from_name(name))
    return (F.when(ext.isin(list(C.DESIGN_EXTS)), "_Design")
             .when(ext.isin(list(C.IMAGE_EXTS)), F.coalesce(year.cast("string"), F.lit("_Undated"))))


def videos_category(ext: Column, name: Column, top: Column) -> Column:
    """CL5: dashcam names, else the first-level folder decides."""
    src = F.lower(F.coalesce(top, F.lit("")))
    cat = (F.when(name.rlike("(?i)" + C.DASHCAM_REGEX), "Dashcam")
            .when(src.isin(list(C.FILM_SOURCES)), "Films")
            .when(src == C.WHATSAPP_SOURCE, "WhatsApp Video")
            .when(src.isin(list(C.FAMILLE_SOURCES)), "Famille")
            .otherwise("_Misc"))
    return F.when(ext.isin(list(C.VIDEO_EXTS)), cat)


def sort_files(manifest: DataFrame, root: str) -> DataFrame:
    """Every file under root (the sort walk applies no skip list)."""
    df = manifest
    if "is_dir" in df.columns:
        df = df.filter(~F.coalesce(F.col("is_dir"), F.lit(False)))
    df = P.derive(df.filter(P.under_root("path", root)), root)
    return df.withColumn("parent_name", P.name_of(F.col("parent")))


def category(files: DataFrame, sort_type: str | Column) -> Column:
    """CL6: the category for the given (or detected) type; NULL = not sorted."""
    t = F.lit(sort_type) if isinstance(sort_type, str) else sort_type
    ext, name, top = F.col("ext"), F.col("name"), F.col("top")
    artist = F.col("artist") if "artist" in files.columns else F.lit(None).cast("string")
    exif = F.col("exif_date") if "exif_date" in files.columns else None
    return (F.when(t == "documents", documents_category(ext, top))
             .when(t == "music", music_category(ext, artist, F.col("parent_name")))
             .when(t == "pictures", pictures_category(ext, name, exif))
             .when(t == "videos", videos_category(ext, name, top))
             .otherwise(mixed_category(ext)))


def resolve_type(files: DataFrame, sort_type: str) -> str:
    """'auto' -> the detected type.  Detection is one global aggregate whose
    single value decides which rule set the plan uses, so it runs first as a
    small job (one string back); the classification plan then carries the
    type as a literal.  (Inlining it as a scalar subquery makes the optimizer
    copy the subquery into every use of the category.)"""
    if sort_type != "auto":
        return sort_type
    return detect_type(files).select("detected_type").first()[0]


def classify(manifest: DataFrame, root: str, sort_type: str = "auto") -> DataFrame:
    """Files with their category for the (given or detected) type."""
    files = sort_files(manifest, root)
    t = resolve_type(files, sort_type)
    return files.withColumn("category", category(files, t)).filter(F.col("category").isNotNull())
