"""Tables of rules, as text: fixed values, whole and in their order."""

from __future__ import annotations

#: Kinds of programming problems: under each kind its patterns with their weights. Fixed values.
PROBLEM_TYPES = r"""
bracket_nesting
  3 \bparenthes
  3 \bbracket
  3 \bnesting
  2 \bbalanced\b
  2 open and clos
  4 \bparen_string\b
  3 opening bracket
  3 deepest level
string_parse
  3 \bparse\b
  3 represented? (as|by) a string
  3 string represent
  4 special ascii format
  3 delimited
  3 separated by (commas|spaces|spaces or commas)
  4 valid date|date is valid|validat
  4 file'?s? name is considered
  4 sentences are delimited
  4 space-delimited string
  4 hexadecimal number as a string
  3 words separated by
  4 music_string
dynamic_programming
  5 \bfib4\b
  5 \bfibfib\b
  5 \btribonacci
  4 \bfibonacci
  2 defined as follows
  4 sub-?array
  3 \bcollatz\b
  3 minimum sum
  3 number of triples
  3 minimum number of (elements|changes)
  5 \bminpath\b
  3 each cell of the grid
  1 table\b
number_theory
  4 \bprime\b
  4 \bdivisor
  4 \bdivides\b
  4 \bfactor
  5 \bgcd\b
  5 greatest common divisor
  3 modulo
  3 divisible
  3 \beven digit
  3 \bodd digit
  3 product of the odd
  3 sum of its digits
  3 unit digits
  2 perfect square
  2 \bcube\b
  3 simple power
  3 multiplication of
base_and_bits
  4 \bbinary\b
  5 change (numerical )?base
  5 roman numeral
  4 \bhexadecimal\b
  4 \bmd5\b
  5 number of ones in their binary
  4 binary (representation|format)
  2 \bbit\b
float_geometry
  3 \bfloat
  3 \bround
  4 \barea\b
  4 \btriangle\b
  4 nearest integer
  4 linear transform
  4 deviation
  3 decimal part
  4 right-angled
  5 \bclosest integer\b
  3 rounded to
  2 squared
  3 \bmean\b
  3 \baverage\b
sorting_select
  4 \bsort
  4 sorted order
  5 \bmedian\b
  3 \bk-th\b
  1 \bmaximum\b
  1 \bminimum\b
  2 \blargest\b
  2 \bsmallest\b
  4 closest to each other
  5 2nd smallest
  2 n-th
  3 ascending order
  2 next odd number
  1 top\b
  2 \bunique elements\b
counting_histogram
  3 \bcount\b
  4 how many (times|distinct|characters)
  4 number of times
  4 \bfrequenc
  5 \bhistogram\b
  4 most repetition
  3 dictionary of
  2 number of elements
  3 number of (even|odd|upper|lower)
  2 appears?\b.*\bdivisible
  3 number of distinct
string_transform
  3 flip\b
  2 \breverse\b
  5 \bremove_vowels\b
  3 \bencod
  3 \bdecod
  3 replace .* with
  3 swap case
  3 \bxor\b
  3 \bcipher|encrypt
  2 substring
  4 same characters
  3 \bpalinfrome|\bpalindrome
  3 words_in_sentence
  2 vowels
  1 \bstring\b
  2 upper characters
  2 \bprefixes\b
  2 alphabet
collection_transform
  4 \bfilter\b
  4 return only
  3 \ball numbers in the\b
  3 \bdictionary\b
  3 \bpolynomial\b
  3 \bcoefficients\b
  3 total number of chars
  1 \blist of\b
  1 \barray\b
  1 \belements?\b
  4 remove (all )?elements
  2 \bindex(es)?\b
  3 \bodd indicies|even indicies|indices\b
  3 \bconcatenate\b
  4 \bcommon elements\b
  3 \bduplicate
  4 \bmonotonic
  2 \bsubset\b
  2 \bmatrix\b
  2 \brow\b
  2 \bcolumn\b
  2 non-negative integer nodes
  3 \bnested list
  3 \bkeys? (are|is)\b
  3 \bderivative\b
scenario_simulation
  3 \bcars?\b
  3 \bwells?\b
  3 \bbucket
  4 \bplanets?\b
  3 \bcarrots?\b
  5 \bwill fly\b
  4 \bbank account
  4 \bbranch of a tree\b
  3 \bclass name\b
  3 \bextensions\b
  5 \bhungry rabbit
  3 \bpile\b
  5 \bbasket of fruit
  3 \bexchanged?\b.*\belements
  2 \brotate\b
  5 event is finally known
  4 \bboredom
  2 guess
  4 balance of the account
arithmetic_basics
  2 \badd\b
  2 \bsum\b
  2 \bproduct\b
  2 sum of
  2 \bdifference\b
  3 \bmultiply
  3 \bequal to the sum\b
  2 less then 100
  1 \bpositive integer n\b
  1 \bnumber x\b
  3 \brange \[
  3 even integer
  2 \binclusive\b
"""


def weighted(text: str) -> dict[str, list[tuple[str, int]]]:
    """A table of kinds, patterns and weights from lines as above."""
    out: dict[str, list[tuple[str, int]]] = {}
    for line in text.strip("\n").split("\n"):
        if line.startswith("  "):
            weight, pattern = line.strip().split(" ", 1)
            out[kind].append((pattern, int(weight)))
        else:
            kind = line
            out[kind] = []
    return out
