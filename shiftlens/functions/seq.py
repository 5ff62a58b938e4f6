"""Column expressions on nucleotide sequences (DNA alphabet)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amino acids of the standard code, codons in the order T, C, A, G of each place.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
#: Stacking energies of neighbouring bases (kcal/mol, rounded), by 16 pairs.
STACK = {"AA": -0.93, "AT": -1.1, "TA": -1.33, "CT": -2.08, "CA": -2.11, "GT": -2.24, "GA": -2.35, "CG": -2.36, "GG": -3.26, "GC": -3.42, "TT": -0.93, "AG": -2.08, "TG": -2.11, "AC": -2.24, "TC": -2.35, "CC": -3.26}
SLIPPERY = r"^(AAA|CCC|GGG|TTT)(AAA|TTT)[ACGT]$"
CANONICAL = r"^(AAA|CCC|GGG|TTT)(AAA|TTT)[ACT]$"
#: Names of chromosomes 1 to 16.
ROMAN = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI".split()


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: the optimizer never copies it into a lambda."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def to_rna(seq: Column) -> Column:
    return F.translate(F.upper(seq), "T", "U")


def resolve_iupac(seq: Column) -> Column:
    return F.translate(F.upper(seq), "RYWS", "ACAC")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def gc_content(seq: Column) -> Column:
    """Per cent of G and C, one decimal; null for an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, F.round(100.0 * F.length(F.regexp_replace(seq, "[^GCgc]", "")) / n, 1))


def gc_stems(seq: Column, parsed: Column) -> Column:
    """Per cent of G and C among the paired bases, one decimal; parsed has a dot for each unpaired base. Null where none is paired."""
    paired = F.filter(F.zip_with(letters(seq), parsed, lambda b, p: F.when((p != ".") & b.isNotNull(), F.upper(b))), lambda b: b.isNotNull())
    return let(paired, lambda own: F.when(F.size(own) > 0, F.round(100.0 * F.size(F.filter(own, lambda b: b.isin("G", "C"))) / F.size(own), 1)))


def orf_slice(seq: Column, start: Column, stop: Column, inclusive: bool = False) -> Column:
    """Bases from start; the last base only if inclusive, as scans never need it."""
    return F.substring(seq, start, stop - start + (1 if inclusive else 0))


def codons(seq: Column, frame: int = 0) -> Column:
    """Whole codons from a 0-based offset; empty where there is none."""
    return F.regexp_extract_all(F.substring(seq, frame + 1, 1 << 30), F.lit("(?s).{3}"), F.lit(0))


def until_stop(seq: Column) -> Column:
    """Codons before the first stop codon of frame 0."""
    return F.regexp_extract(seq, "^(?:(?!TAA|TAG|TGA)[ACGTN]{3})*+", 0)


def translate(seq: Column, frame: int = 0) -> Column:
    """Amino acids by the place of each base in TCAG; codons with another letter give '?'."""
    return F.array_join(amino_letters(codons(seq, frame)), "")


def amino_letters(codons: Column) -> Column:
    def amino(codon: Column) -> Column:
        digits = [F.position(F.substring(codon, F.lit(k), F.lit(1)), F.lit("TCAG")) for k in (1, 2, 3)]
        place = 16 * digits[0] + 4 * digits[1] + digits[2] - 20
        return F.when((digits[0] > 0) & (digits[1] > 0) & (digits[2] > 0), F.substring(F.lit(AMINO), place, F.lit(1))).otherwise("?")

    return F.transform(codons, amino)


def stop_marks(codons: Column) -> Column:
    """'*' for each codon that ends a frame: a stop, or one with a letter that isn't a base."""
    return F.transform(codons, lambda c: F.when(c.isin("TAA", "TAG", "TGA") | (F.translate(c, "ACGTN", "") != ""), "*").otherwise("."))


def upto_stop(protein: Column) -> Column:
    return F.substring_index(protein, "*", 1)


def minus_frame_track(seq: Column) -> Column:
    """The -1 frame (offset 2): stop codons kept, other codons as dots, padded to the length of the sequence."""
    track = F.array_join(F.transform(codons(seq, 2), lambda c: F.when(c.isin("TAA", "TAG", "TGA"), c).otherwise("...")), "")
    return F.rpad(track, F.length(seq), ".")


def letters(seq: Column) -> Column:
    """The bases as an array, so that places are found without walking the string."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def word_positions(seq: Column, word: str) -> Column:
    """1-based places of a word, overlapping ones too."""

    def places(bases: Column) -> Column:
        here = lambda i: F.array_join(F.slice(bases, i, len(word)), "") == word
        return F.filter(F.sequence(F.lit(1), F.size(bases) - len(word) + 1), lambda i: (F.get(bases, i - 1) == word[0]) & here(i))

    return F.when(F.length(seq) >= len(word), let(letters(seq), places)).otherwise(none_of("int"))


def kmers(seq: Column, k: int) -> Column:
    def words(bases: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(bases) - k + 1), lambda i: F.array_join(F.slice(bases, i, k), ""))

    return F.when(F.length(seq) >= k, let(letters(seq), words)).otherwise(none_of("string"))


def stack_energy(seq: Column) -> Column:
    """Sum of neighbour stacking weights in hundredths: an energy proxy, not a folding energy."""

    def total(text: Column) -> Column:
        out = F.lit(0)
        for pair, weight in STACK.items():
            out = out + F.regexp_count(text, F.lit(f"{pair[0]}(?={pair[1]})")) * round(weight * 100)
        return out

    return let(seq, total)


def species_key(name: Column) -> Column:
    """genus_species in lower case without brackets; viruses share one key."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[\[\]()]", ""), r"[\s-]+", "_")
    return F.when(clean.contains("virus"), F.lit("virus")).otherwise(F.regexp_extract(clean, r"^([^_]+(_[^_]+)?)", 1))


def species_label(key: Column) -> Column:
    """The key for reading: words parted by spaces, the first letter in upper case."""
    words = F.regexp_replace(F.trim(key), "_+", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))


def is_slippery(heptamer: Column, canonical_only: bool = False) -> Column:
    """Whether a heptamer is one of the 32 slippery ones; canonical_only leaves out those that end in G. U counts as T, null is null."""
    return F.translate(F.upper(heptamer), "U", "T").rlike(CANONICAL if canonical_only else SLIPPERY)


def heptamer_at(seq: Column, start: Column) -> Column:
    """The seven bases from a 1-based place; null where fewer are left."""
    return F.when((start >= 1) & (start + 6 <= F.length(seq)), F.substring(seq, start, F.lit(7)))


def clean_accession(accession: Column, mode: str = "version") -> Column:
    """Without the prefix SGDID: and without a version (mode version), or with underscores for dots (mode underscore)."""
    plain = F.regexp_replace(accession, "^SGDID:", "")
    return F.translate(plain, ".", "_") if mode == "underscore" else F.regexp_replace(plain, r"\.[0-9]+$", "")


def chromosome_label(n: Column) -> Column:
    """Roman numeral of a chromosome 1 to 16 (a number or its text, also behind `chr`); others stay as they are."""
    text = F.regexp_replace(n.cast("string"), "^(?i:chr)0*", "")
    return F.coalesce(F.try_element_at(F.array(*[F.lit(r) for r in ROMAN]), F.nullif(text.try_cast("int"), F.lit(0))), n.cast("string"))


def relative_position(start: Column, orf_start: Column, orf_stop: Column) -> Column:
    """Struct of a place's distance from the ORF's start and its share of the ORF in whole per cent; null for an empty ORF."""
    size = orf_stop - orf_start
    return F.struct((start - orf_start).alias("distance"), F.when(size > 0, F.round(100.0 * (start - orf_start) / size).cast("int")).alias("percent"))


#: A prime below 2^31 and two steps: keys of a shuffle are squares modulo it, which built-in functions of any engine can follow.
PRIME, STEP, SHIFT = 2147483647, 1103515245, 741103597


def shuffle_key(h: Column, i: Column) -> Column:
    """A number below PRIME from a row's draw h and a place i, by two squarings of a linear step."""
    x = (h * 7 + i * STEP) % PRIME
    y = (x * x + i * SHIFT) % PRIME
    return (y * y + x) % PRIME


def shuffled(seq: Column, *seed: Column) -> Column:
    """Bases in the order of keys drawn from md5(seed) and their places: the composition is kept. One digest a sequence."""
    text = F.concat_ws("|", *[s.cast("string") for s in seed])
    draw = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")

    def ordered(bases: Column) -> Column:
        # the place rides in the low bits, so whole numbers are sorted
        keys = let(draw, lambda h: F.transform(bases, lambda _, i: shuffle_key(h, i.cast("long")) * (1 << 31) + i))
        return F.array_join(F.transform(F.sort_array(keys), lambda v: F.get(bases, (v % (1 << 31)).cast("int"))), "")

    return let(letters(seq), ordered)


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, error under 2e-7."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-z * z) / 2.0
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def xref_ids(xrefs: Column, kind: str) -> Column:
    """Ids of one kind (MIM, HGNC, GeneID) among cross-references like `HGNC:1234`, by a space; null where there is none."""
    own = F.filter(xrefs, lambda x: x.startswith(kind + ":"))
    return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda x: F.substring(x, len(kind) + 2, 1 << 30)), " "))


#: Sentences that a curated record's comment repeats.
BOILERPLATE = (
    "REVIEWED REFSEQ: This record has been curated by NCBI staff.",
    "This sequence is a reference standard in the RefSeqGene project.",
    "VALIDATED REFSEQ: This record has undergone validation or preliminary review.",
)


def clean_refseq_comment(comment: Column) -> Column:
    """The comment without the fixed sentences and without `[provided by RefSeq, ...].`"""
    for sentence in BOILERPLATE:
        comment = F.replace(comment, F.lit(sentence), F.lit(""))
    return F.regexp_replace(comment, r"\[provided by RefSeq, .+\]\.", "")


def alternates(amino: Column, spec: Column) -> Column:
    """Codons of an amino acid that fit a spec such as `A.G`, where a dot stands for any base; empty for an unknown letter."""
    own = literal_map_of_codons()
    fits = lambda codon, k: (F.substring(spec, k, 1) == ".") | (F.substring(spec, k, 1) == F.substring(codon, k, 1))
    return F.coalesce(F.filter(F.element_at(own, amino), lambda c: fits(c, 1) & fits(c, 2) & fits(c, 3)), none_of("string"))


def literal_map_of_codons() -> Column:
    letters_ = sorted(set(AMINO))
    return F.create_map(*[x for a in letters_ for x in (F.lit(a), F.array(*[F.lit(c) for c, b in zip(CODONS, AMINO) if b == a]))])


def normalise_spaces(coded: Column) -> Column:
    """An encoded array with no space before it and single spaces inside, where it starts with a space; else as it is."""
    return F.when(coded.rlike(r"^\s"), F.regexp_replace(F.regexp_replace(coded, r"^\s+", ""), r"\s+", " ")).otherwise(coded)
