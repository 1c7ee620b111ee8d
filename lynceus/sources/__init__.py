"""Readers: folders of images and point clouds, rosters of frames, earlier reports."""
