"""Analyses by name, with their citations: the extension point for own functions."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Entry:
    name: str
    function: Callable
    kinds: tuple[str, ...]
    citations: tuple[str, ...] = ()
    deprecated: bool = False


@dataclass
class Registry:
    entries: dict[tuple[str, str], Entry] = field(default_factory=dict)

    def register(self, name: str, *kinds: str, citations: tuple[str, ...] = (), deprecated: bool = False):
        """A decorator for kinds out of 'uniform', 'map', 'nonuniform', 'container'."""

        def add(function: Callable) -> Callable:
            for k in kinds:
                self.entries[k, name] = Entry(name, function, kinds, citations, deprecated)
            return function

        return add

    def apply(self, kind: str, name: str, *args, **kwargs):
        try:
            e = self.entries[kind, name]
        except KeyError:
            raise AttributeError(f"{kind} surfaces have no {name!r}; there are: {', '.join(sorted(n for k, n in self.entries if k == kind))}") from None
        if e.deprecated:
            warnings.warn(f"{name} is deprecated", DeprecationWarning, stacklevel=2)
        return e.function(*args, **kwargs)


registry = Registry()


def _fill() -> None:
    from ..operators import bandwidth, bearing, detrend, geometry, kernels, regression, robust, scalars, spectral, stencils, tiles, transforms
    from . import container

    for kinds, table in {
        ("uniform",): {"Rq": scalars.rq, "Rdq": scalars.rdq, "Rddq": scalars.rddq, "power_spectrum_from_profile": spectral.power_spectrum, "autocorrelation_from_profile": spectral.autocorrelation, "variable_bandwidth_from_profile": bandwidth.variable_bandwidth, "bearing_area": bearing.bearing_line, "derivative": stencils.line_derivative, "scale_dependent_statistical_property": stencils.scale_dependent, "detrend": detrend.detrend, "median": robust.median_mad_line, "mad_height": robust.median_mad_line, "mad_polyfit": robust.mad_trend, "filter": kernels.fourier_filter, "shortcut": kernels.shortcut, "longcut": kernels.longcut, "scan_with_rigid_sphere": transforms.scan_with_sphere, "interpolate_undefined_data": transforms.interpolate_undefined_line, "window": transforms.window, "scanning_probe_reliability_cutoff": kernels.scanning_probe_cutoff, "checkerboard_detrend_profile": bandwidth.checkerboard_line, "moments": scalars.moments_line, "patches": geometry.runs},
        ("map",): {"Sq": scalars.sq, "rms_gradient": stencils.rms_gradient, "rms_laplacian": stencils.rms_laplacian, "power_spectrum_from_area": spectral.psd_area, "autocorrelation_from_area": spectral.autocorrelation_area, "autocorrelation_rings": spectral.autocorrelation_rings, "variable_bandwidth_from_area": bandwidth.variable_bandwidth_map, "bearing_area": bearing.bearing_map, "bearing_area_bounds": bearing.bounds_map, "median": robust.median_mad_map, "mad_height": robust.median_mad_map, "derivative": stencils.map_derivative, "detrend": detrend.detrend_map, "transpose": transforms.transpose, "translate": transforms.translate, "superpose": transforms.superpose, "mirror_stitch": transforms.mirror_stitch, "downsample": transforms.downsample, "scan_line_align": transforms.align_lines, "fourier_derivative": kernels.fourier_derivative, "interpolate_fourier": kernels.interpolate_fourier, "interpolate_undefined_data": tiles.fill_harmonic, "filter": kernels.filter_map, "checkerboard_detrend_area": bandwidth.checkerboard_map, "patches": geometry.patches, "pair_correlation": geometry.pair_correlation, "perimeter_length": geometry.perimeter_length},
        ("nonuniform",): {"statistics": scalars.nonuniform, "Rddq": scalars.nonuniform_rddq, "moment": scalars.nonuniform_moment, "bandwidth": scalars.bandwidth, "power_spectrum_from_profile": spectral.psd_nonuniform, "autocorrelation_from_profile": spectral.autocorrelation_nonuniform, "bearing_area": bearing.bearing_nonuniform, "median": robust.median_mad_nonuniform, "mad_height": robust.median_mad_nonuniform, "derivative": stencils.nonuniform_derivative, "detrend": detrend.detrend_nonuniform, "variable_bandwidth_from_profile": bandwidth.variable_bandwidth_nonuniform, "checkerboard_detrend_profile": bandwidth.checkerboard_nonuniform, "to_uniform": transforms.to_uniform, "scan_with_rigid_sphere": transforms.scan_with_sphere_nonuniform, "interpolate_linear": transforms.interpolated, "interpolate_cubic": transforms.interpolated_cubic, "is_reentrant": scalars.is_reentrant},
        ("container",): {"log_average": container.log_average, "bandwidth": container.bandwidth, "suggest_length_unit": container.suggest_length_unit, "integrate_psd_from_profile": container.integrate_psd, "c1d_moment": container.profile_moment, "variance_half_derivative_from_autocorrelation": container.half_derivative_variance, "scale_dependent_statistical_property": container.scale_dependent_average},
        ("uniform", "map", "nonuniform", "container"): {"resample_gaussian_process": regression.gaussian_process},
        ("uniform", "map", "nonuniform"): {"scale": transforms.scale, "basic": scalars.basic, "fill_undefined_data": transforms.fill_undefined},
    }.items():
        for name, f in table.items():
            registry.register(name, *kinds)(f)


_fill()
