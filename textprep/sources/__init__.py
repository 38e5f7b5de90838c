from textprep.sources.idvalue import read_id_value_lines
from textprep.sources.labelled import (
    MISSING_VALUES,
    PROFILE_COLUMNS,
    inline_rows,
    read_labelled,
    read_tweets,
    require_columns,
    union_labelled,
    with_label,
)
from textprep.sources.reports import write_report
from textprep.sources.tables import read_table
from textprep.sources.vectors import limit_vectors, read_vectors, write_vectors

__all__ = [n for n in dir() if not n.startswith("_")]
