"""Queries over the testbed's tables, each with its SQL twin.

The tables stand in for a catalogue: customer for artists, orders for releases, lineitem for tracks, part for reference
releases, nation and region for genres, events for plays, conversations for playlists and messages.
"""
