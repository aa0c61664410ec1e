"""Run configuration: the keys of a control file as a dataclass, with its parser and checks."""

from __future__ import annotations

import dataclasses
import math
import warnings

#: Fixed values.
COS_LIMIT = 1.0 - 1e-6
AXIS_EPS = 1e-6
BOLTZMANN = 0.0019872041
PI = 3.1415926  # as in radial distribution functions
DEGREES_PER_RADIAN = 180.0 / math.pi
CLASSES = ("nonbonded", "bond", "angle", "dihedral", "density", "threebody")
MODES = ("none", "fm", "tab", "fm+tab", "tab+fm")
#: Basis types by their number in a control file; bspline_and_derivative fits energies.
BASIS_TYPES = ("bspline", "linear", "bspline_and_derivative", "none")

#: The keys of a control file, by the setting that each one gives.
KEYS = {
    "start_frame": "start_frame",
    "n_frames": "n_frames",
    "block_size": "block_size",
    "dim": "position_dimension",
    "nonbonded_cutoff": "nonbonded_cutoff",
    "density_cutoff": "density_cutoff_distance",
    "basis_type": "basis_type",
    "matrix_type": "matrix_type",
    "nonbonded_order": "pair_nonbonded_bspline_basis_order",
    "bond_order": "pair_bond_bspline_basis_order",
    "angle_order": "angle_bspline_basis_order",
    "dihedral_order": "dihedral_bspline_basis_order",
    "density_order": "density_bspline_basis_order",
    "threebody_order": "three_body_nonbonded_bspline_basis_order",
    "nonbonded_bin_width": "pair_nonbonded_basis_set_resolution",
    "bond_bin_width": "pair_bond_basis_set_resolution",
    "angle_bin_width": "angle_basis_set_resolution",
    "dihedral_bin_width": "dihedral_basis_set_resolution",
    "density_bin_width": "density_basis_set_resolution",
    "threebody_bin_width": "three_body_nonbonded_basis_set_resolution",
    "nonbonded_output_width": "pair_nonbonded_output_binwidth",
    "bond_output_width": "pair_bond_output_binwidth",
    "angle_output_width": "angle_output_binwidth",
    "dihedral_output_width": "dihedral_output_binwidth",
    "density_output_width": "density_output_binwidth",
    "threebody_output_width": "three_body_nonbonded_output_binwidth",
    "nonbonded_values": "output_pair_nonbonded_parameter_distribution",
    "bond_values": "output_pair_bond_parameter_distribution",
    "angle_values": "output_angle_parameter_distribution",
    "dihedral_values": "output_dihedral_parameter_distribution",
    "density_values": "output_density_parameter_distribution",
    "angle_style": "angle_type",
    "dihedral_style": "dihedral_type",
    "density_style": "density_interactions_flag",
    "density_weights": "density_weights_flag",
    "threebody_style": "three_body_nonbonded_style",
    "threebody_exclusion_style": "three_body_nonbonded_exclusion_type",
    "threebody_gamma": "stillinger_weber_gamma",
    "exclusion_style": "excluded_style",
    "density_exclusion_style": "density_excluded_style",
    "most_bonds": "max_pair_bonds_per_site",
    "most_angles": "max_angles_per_site",
    "most_dihedrals": "max_dihedrals_per_site",
    "rcond": "rcond",
    "most_iterations": "itnlim",
    "sparse_safety": "sparse_safety_factor",
    "sparse_threads": "num_sparse_threads",
    "regularization_style": "regularization_style",
    "tikhonov_parameter": "regularization_scalar",
    "bayesian": "bayesian_mscg_flag",
    "bayesian_iterations": "bayesian_max_iterations",
    "iterative": "lanyuan_iterative_method_flag",
    "iteration_step": "iteration_step_size",
    "bootstrap": "bootstrapping_flag",
    "bootstrap_outputs": "bootstrapping_full_output_flag",
    "bootstrap_replicas": "bootstrapping_num_estimates",
    "bootstrap_samples": "bootstrapping_num_subsamples",
    "random_seed": "random_num_seed",
    "temperature": "temperature",
    "boltzmann": "boltzmann",
    "use_frame_weights": "use_statistical_reweighting",
    "volume_weighting": "volume_weighting_flag",
    "virial_constraint": "constrain_pressure_flag",
    "dynamic_types": "dynamic_types",
    "state_sampling": "dynamic_state_sampling",
    "state_samples": "dynamic_state_samples_per_frame",
    "output_style": "primary_output_style",
    "output_solution": "output_solution_flag",
    "output_coefficients": "output_spline_coeffs_flag",
    "output_equations": "output_normal_equations_rhs_flag",
    "output_residual": "output_residual_flag",
}


@dataclasses.dataclass(frozen=True)
class Control:
    """Settings of a run; KEYS names the control key of each."""

    start_frame: int = 1
    n_frames: int = 10
    block_size: int = 10
    dim: int = 3
    nonbonded_cutoff: float = 1.0
    density_cutoff: float = 10.0
    basis_type: str = "bspline"
    matrix_type: int = 0
    nonbonded_order: int = 4
    bond_order: int = 4
    angle_order: int = 4
    dihedral_order: int = 4
    density_order: int = 4
    threebody_order: int = 4
    nonbonded_bin_width: float = 0.05
    bond_bin_width: float = 0.05
    angle_bin_width: float = 1.0
    dihedral_bin_width: float = 1.0
    density_bin_width: float = 0.5
    threebody_bin_width: float = 1.0
    nonbonded_output_width: float = 0.05
    bond_output_width: float = 0.05
    angle_output_width: float = 1.0
    dihedral_output_width: float = 1.0
    density_output_width: float = 0.1
    threebody_output_width: float = 0.2
    nonbonded_values: int = 0
    bond_values: int = 0
    angle_values: int = 0
    dihedral_values: int = 0
    density_values: int = 0
    angle_style: int = 0
    dihedral_style: int = 0
    density_style: int = 0
    density_weights: int = 0
    threebody_style: int = 0
    threebody_exclusion_style: int = 0
    threebody_gamma: float = 0.12
    exclusion_style: int = 2
    density_exclusion_style: int = 0
    most_bonds: int = 4
    most_angles: int = 12
    most_dihedrals: int = 36
    rcond: float = -1.0
    most_iterations: int = 0
    sparse_safety: float = 0.2
    sparse_threads: int = 1
    regularization_style: int = 0
    tikhonov_parameter: float = 0.0
    bayesian: int = 0
    bayesian_iterations: int = 1
    iterative: int = 0
    iteration_step: float = 1.0
    bootstrap: int = 0
    bootstrap_outputs: int = 0
    bootstrap_replicas: int = 1
    bootstrap_samples: int = 1
    random_seed: int = 1
    temperature: float = 300.0
    boltzmann: float = BOLTZMANN
    use_frame_weights: int = 0
    volume_weighting: int = 0
    virial_constraint: int = 0
    dynamic_types: int = 0
    state_sampling: int = 0
    state_samples: int = 1
    output_style: int = 0
    output_solution: int = 0
    output_coefficients: int = 0
    output_equations: int = 0
    output_residual: int = 0

    def check(self) -> Control:
        """Raises ValueError for settings that no run can have; returns itself."""
        if self.n_frames < 1 or self.start_frame < 0 or self.block_size < 1:
            raise ValueError("numbers of frames must be positive")
        if self.n_frames % self.block_size:
            raise ValueError(f"{self.n_frames} frames are not a multiple of the block size {self.block_size}")
        if self.basis_type not in BASIS_TYPES:
            raise ValueError(f"unknown basis type {self.basis_type!r}")
        if min(self.nonbonded_order, self.bond_order, self.angle_order, self.dihedral_order, self.density_order, self.threebody_order) < 1:
            raise ValueError("spline order must be at least 1")
        if self.exclusion_style not in (0, 2, 3, 4, 5):
            raise ValueError(f"unknown exclusion style {self.exclusion_style}")
        if min(self.nonbonded_bin_width, self.bond_bin_width, self.angle_bin_width, self.dihedral_bin_width, self.nonbonded_output_width, self.bond_output_width, self.angle_output_width, self.dihedral_output_width) <= 0:
            raise ValueError("bin widths must be positive")
        return self


def parse_control(text: str, strict: bool = True) -> Control:
    """A Control from `key value` lines; text after the value is comment. An unknown key raises ValueError, or warns if not `strict`.

    `Temperature` is the same as `temperature`; a basis type may be a number or a name.
    """
    kinds = {KEYS[f.name]: (f.name, type(f.default)) for f in dataclasses.fields(Control)}
    given: dict = {}
    for number, line in enumerate(text.splitlines(), 1):
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        key = "temperature" if parts[0] == "Temperature" else parts[0]
        if key not in kinds:
            said = f"unknown control key {key!r} in line {number}"
            if strict:
                raise ValueError(said)
            warnings.warn(said, stacklevel=2)
            continue
        name, kind = kinds[key]
        value = parts[1]
        if name == "basis_type":
            given[name] = BASIS_TYPES[int(value)] if value.isdigit() and int(value) < len(BASIS_TYPES) else value
        else:
            given[name] = kind(float(value)) if kind is int else kind(value)
    return Control(**given)
