"""End-to-end pipelines as chains of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import assign, decode, find_spots, pixel_decode, segment, tile_filters, traces
from ..operators.levels import Levels
from ..operators.tiles import to_pixels


def spot_pipeline(tiles: DataFrame, codes: DataFrame, rounds: int, channels: int, ticks: DataFrame | None = None, masking_radius: int = 5, min_sigma: float = 1, max_sigma: float = 3, num_sigma: int = 5, threshold: float = 0.05) -> DataFrame:
    """In-situ sequencing: background off, spots found on the projection and measured everywhere, decoded by the largest channel per round."""
    clean = tile_filters.white_tophat(tiles, masking_radius)
    spots = find_spots.blob_detector(clean, min_sigma, max_sigma, num_sigma, threshold, reference=find_spots.projection(clean))
    features = traces.exact_match(spots, rounds, channels)
    features = features if ticks is None else traces.physical_coords(features, ticks)
    return decode.decode_per_round_max(features, codes, rounds, channels)


def pixel_pipeline(tiles: DataFrame, codes: DataFrame, size: int, high_sigma: float = 3, low_sigma: float = 1, iterations: int = 2, psf_sigma: float = 1, distance: float = 0.5, magnitude: float = 0.01, min_area: int = 1, max_area: int = 1000) -> DataFrame:
    """Pixel decoding: high pass, deconvolution, low pass, nearest code per pixel, components."""
    out = tile_filters.gaussian_high_pass(tiles, high_sigma)
    out = tile_filters.deconvolve_psf(out, iterations, psf_sigma, method=Levels.SCALE_SATURATED_BY_CHUNK)
    out = tile_filters.gaussian_low_pass(out, low_sigma)
    return pixel_decode.pixel_spot_decoder(to_pixels(out), codes, size, "euclidean", distance, magnitude, min_area, max_area)


def cells_by_genes(decoded: DataFrame, primary: DataFrame, nuclei: DataFrame, nuclei_threshold: float, input_threshold: float, min_distance: int | None) -> DataFrame:
    """Cells segmented from nuclei and stain, decoded features put in them and counted: (cell_id, gene, n)."""
    masks = segment.watershed_cells(primary, nuclei, nuclei_threshold, input_threshold, min_distance)
    return assign.expression_long(assign.assign_targets(decoded, masks))
