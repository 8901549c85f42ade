from epiframe.functions.alphabet import RESIDUE_CODES, alphabet_map
from epiframe.functions.encode import (
    assemble,
    encode_letters,
    multi_hot,
    one_hot,
    pad_middle,
    peptide_vector,
    slice_features,
    strip_blanks,
)
from epiframe.functions.activations import relu, sigmoid, sigmoid_log_loss
from epiframe.functions.linear import affine

__all__ = [
    "RESIDUE_CODES", "alphabet_map", "assemble", "encode_letters", "multi_hot",
    "one_hot", "pad_middle", "peptide_vector", "slice_features", "strip_blanks",
    "relu", "sigmoid", "sigmoid_log_loss", "affine",
]
