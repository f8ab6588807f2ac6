"""Column functions over oriented nodes, walks and sequences. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from walkweave.schema import MINUS_TERMINUS, PLUS_TERMINUS, TERMINAL_NODES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sequence_complement(seq: Column | str) -> Column:
    """Reverse complement of A, C, G, T; any other letter, small ones too, stays."""
    return F.translate(F.reverse(_col(seq)), "ACGT", "TGCA")


def flip(orient: Column | str) -> Column:
    """'+' for '-' and the other way round; anything else is an error."""
    o = _col(orient)
    return F.when(o.isin("+", "-"), F.translate(o, "+-", "-+")).otherwise(F.raise_error(F.concat(F.lit("not an orientation: "), F.coalesce(o, F.lit("null")))).cast("string"))


def node_complement(node: Column | str) -> Column:
    """The node with its last sign flipped; null stays null."""
    n = _col(node)
    return F.when(n.isNotNull(), F.concat(F.substring(n, F.lit(1), F.length(n) - 1), flip(F.right(n, F.lit(1)))))


def edge_complement(u: Column | str, v: Column | str) -> Column:
    return F.struct(node_complement(v).alias("u"), node_complement(u).alias("v"))


def edge_number(u: Column | str, v: Column | str) -> Column:
    """A number of 60 bits from an edge's names."""
    return F.conv(F.left(F.md5(F.concat_ws("|", _col(u), _col(v))), F.lit(15)), 16, 10).cast("long")


def canonical(u: Column | str, v: Column | str) -> Column:
    """Of an edge's two readings the smaller."""
    own, other = F.struct(_col(u).alias("u"), _col(v).alias("v")), edge_complement(u, v)
    return F.when(own <= other, own).otherwise(other)


def walk_complement(steps: Column | str) -> Column:
    return F.reverse(F.transform(_col(steps), node_complement))


def segment_of(node: Column | str) -> Column:
    n = _col(node)
    return F.substring(n, F.lit(1), F.length(n) - 2)


def node_id_symbol(node: Column | str) -> Column:
    """(id, symbol) of an oriented node, termini included."""
    return F.struct(segment_of(node).alias("id"), F.right(_col(node), F.lit(1)).alias("symbol"))


def node_recover(node: Column | str) -> Column:
    """'>X' for X_+, '<X' for X_-; the termini are called startTerminus and endTerminus."""
    seg = segment_of(node)
    name = F.when(seg == PLUS_TERMINUS, "startTerminus").when(seg == MINUS_TERMINUS, "endTerminus").otherwise(seg)
    return F.concat(F.when(F.right(_col(node), F.lit(1)) == "+", ">").otherwise("<"), name)


def node_convert(name: Column | str) -> Column:
    """X_+ for '>X', X_- for '<X'."""
    n = _col(name)
    return F.concat(F.substring(n, F.lit(2), F.length(n)), F.when(F.left(n, F.lit(1)) == ">", "_+").otherwise("_-"))


def tokenize_walk(walk: Column | str) -> Column:
    """The oriented nodes of a walk such as >a<b>c: each word takes the sign right before it, and words without one are dropped."""
    found = F.regexp_extract_all(_col(walk), F.lit(r"(?U)([<>])[^\w<>]*(\w+)"), F.lit(0))
    return F.transform(found, lambda t: F.concat(F.regexp_extract(t, r"(?U)(\w+)$", 1), F.when(F.left(t, F.lit(1)) == ">", "_+").otherwise("_-")))


def is_terminal_node(node: Column | str) -> Column:
    return _col(node).isin(*TERMINAL_NODES)


def nearly_identical(a: Column | str, b: Column | str, threshold: int = 10) -> Column:
    """Whether two alleles of at least 2 * threshold letters together differ by one edit at most."""
    a, b = _col(a), _col(b)
    return (F.length(a) + F.length(b) >= 2 * threshold) & (F.levenshtein(a, b, 1) != -1)


def info_map(info: Column | str) -> Column:
    """INFO as a map; flags have a null value, and of k=a=b the value is a."""
    pairs = F.str_to_map(_col(info), F.lit(";"), F.lit("="))
    return F.transform_values(pairs, lambda _, v: F.element_at(F.split(v, "="), 1))


def bubble_nodes(text: Column | str) -> Column:
    """The oriented nodes named by >x and <x in a text."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(r"(?U)[><]\w+"), F.lit(0)), node_convert)


def bubble_ends(text: Column | str, oriented: bool = False) -> Column:
    """The two ends in a bubble's id; any other number of nodes is an error."""
    nodes = bubble_nodes(text)
    out = nodes if oriented else F.transform(nodes, segment_of)
    return F.when(F.size(nodes) == 2, out).otherwise(F.raise_error(F.concat(F.lit("a bubble's id names two nodes: "), F.coalesce(_col(text), F.lit("null")))).cast("array<string>"))


def repeat_motif(allele: Column | str) -> Column:
    """The shortest m of which the allele is a repetition; null for empty alleles and those with an N.

    The shortest period of a text s is the first place after its start at which s stands in s + s."""
    a = _col(allele)
    period = F.call_function("locate", a, F.concat(a, a), F.lit(2)) - 1
    return F.when((F.length(a) > 0) & ~F.contains(a, F.lit("N")), F.left(a, period))
