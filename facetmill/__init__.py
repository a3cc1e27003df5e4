"""Part of facetmill."""
